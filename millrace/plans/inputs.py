"""Records derived from the test tables: each as a DataFrame and, in SQL, as a common table expression.

`SQL` maps a name to its expression; an expression may name others, which `with_inputs` puts before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences that messages end with, by msg_id; together they reach every verdict.
TEMPLATES = (
    "See you at the meeting.",
    "Urgent: verify your account today or it stays blocked.",
    "Buy a gift card and do not tell anyone.",
    "Your free trial ends soon, the fee will go up.",
    "Please pay $1,250.00 by March 14 and 300 dollars later.",
    "Click here, you have won the lottery.",
    "The package arrives before 12/24/2025.",
    "Police will arrest you; send bitcoin or a wire transfer now.",
    "An early termination cancel fee applies.",
    "Our bank security team says a refund is pending.",
)
#: Labels that forms ask for, by position.
LABELS = ("Full name", "E-mail", "Email address", "Phone number", "Company name", "Community", "Statement", "PIN", "Shipping address", "Card number", "Shoe size", "Zip code", "Full name", "Birth date", "Password (again)")
#: Names of stored secrets that forms may refer to.
NAMES = ("card_number", "password_main", "sort_code")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(n: Column, *values: str) -> Column:
    """values[n % len(values)]."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def sql_pick(n: str, *values: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][({n} % {len(values)} + 1)::INT]"


HIGHER, LOWER = ("Speed", "speed", "cost", "SPEED", "safety", "Speed"), ("cost", "Cost", "speed", "cost", "Speed", "Safety")


def correction_log(events: DataFrame) -> DataFrame:
    """owner_id, seq, context, higher, lower, confidence, ts of events, streaming or not; every 41st is a declaration."""
    n = F.col("event_id")
    declared = F.when(n % 41 == 0, F.pmod(n, F.lit(120)) / 100)
    return events.select(F.col("user_id").alias("owner_id"), n.alias("seq"), F.when(n % 5 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("context"), pick(n, *HIGHER).alias("higher"), pick(n, *LOWER).alias("lower"), declared.alias("confidence"), "ts")


def corrections(spark: SparkSession, d: str) -> DataFrame:
    return correction_log(table(spark, d, "events"))


def owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("owner_id")).distinct()


def facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 150).alias("owner_id"), F.col("p_partkey").alias("seq"), F.concat(F.lit("  "), "p_name", F.lit(" "), F.lower("p_type"), F.lit("\t")).alias("fact"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("category"))


def goals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    goal = F.concat(F.lit(" "), F.lit("finish "), F.lower("o_orderpriority"), F.lit(" order "), (F.col("o_orderkey") % 97).cast("string"))
    return o.select((F.col("o_custkey") % 150).alias("owner_id"), F.col("o_orderkey").alias("seq"), goal.alias("goal"), (F.col("o_orderstatus") == "O").alias("active"))


LEVELS_SET = ("act", "recommend", "act", "observe", "always", "act")


def permission_entries(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, seq, category, level, cap: nine settings an owner, some later overridden, some of no known level."""
    i = F.col("i")
    n = F.col("owner_id") * 9 + i
    entries = owners(spark, d).select("owner_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("i"))
    cap = F.when(n % 4 == 1, F.lit(0.0)).when(n % 4 > 1, (n % 11 * 50000).cast("double"))
    return entries.select("owner_id", n.alias("seq"), pick(i, " 1-Urgent", "2-HIGH ", "3-medium", "4-NOT SPECIFIED", "1-URGENT", "2-high").alias("category"), pick(n, *LEVELS_SET).alias("level"), cap.alias("cap"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    amount = F.when(n % 13 == 0, F.lit(None).cast("double")).when(n % 13 == 1, -F.col("o_totalprice")).when(n % 13 == 2, F.lit(50000.0)).otherwise(F.col("o_totalprice"))
    return o.select((F.col("o_custkey") % 150).alias("owner_id"), n.alias("seq"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("order "), n.cast("string")).alias("description"), amount.alias("amount"))


def permission_log(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh order as a setting among the requests, so that later ones override earlier ones."""
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    cap = F.when(n % 4 > 0, (n % 11 * 50000).cast("double"))
    return o.where(n % 7 == 0).select((F.col("o_custkey") % 150).alias("owner_id"), n.alias("seq"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("category"), pick(F.col("o_custkey"), *LEVELS_SET).alias("level"), cap.alias("cap"))


def logged_requests(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).where(F.col("seq") % 7 > 0)


NEEDLES = {"forget": ("RING", "st", "zzz", "economy", "", "a"), "close": ("HIGH", "order 1", "urgent", "5-low", "r 7", "9"), "resolve": ("part 1", "PART 12", "7", "art 9", "33", "0")}
#: How far apart an owner's commands of a kind are, so that they stand among the rows they change.
STRIDE = {"forget": 1, "close": 10, "resolve": 80}


def commands(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, seq, kind, needle, outcome: one of each customer, over the places of the rows they change."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    kinds = tuple(NEEDLES)
    kind, third = pick(n, *kinds), F.floor(n / 3).cast("long")
    each = lambda f: F.when(F.col("kind") == kinds[0], f(kinds[0])).when(F.col("kind") == kinds[1], f(kinds[1])).otherwise(f(kinds[2]))
    named = c.select((n % 150).alias("owner_id"), n.alias("n"), kind.alias("kind"), third.alias("third"))
    return named.select("owner_id", (F.col("n") * each(lambda k: F.lit(STRIDE[k]))).alias("seq"), "kind", each(lambda k: pick(F.col("third"), *NEEDLES[k])).alias("needle"), F.when(F.col("third") % 2 == 0, "late").alias("outcome"))


#: Tool calls by event_id: the tool, its arguments (#n is a number of the event, #e its type) and what is wrong with them.
CALLS = (
    ("record_correction", '{"context": "#e", "what_was_suggested": "x", "what_user_chose": "y", "value_protected": "Speed", "value_traded_away": "cost"}', None),
    ("set_priority", '{"context": "#e", "higher": "cost", "lower": "speed"}', None),
    ("record_correction", '{"context": "#e", "what_was_suggested": "", "what_user_chose": "", "value_protected": "cost", "value_traded_away": "Speed"}', None),
    ("remember_fact", '{"fact": " part #n of #e ", "category": null}', None),
    ("forget", '{"contains": "PART #n"}', None),
    ("remember_fact", '{"fact": "likes #e", "category": "taste", "more": [1]}', None),
    ("forget", '{"contains": ""}', "needle"),
    ("add_goal", '{"goal": "order #n"}', None),
    ("close_goal", '{"contains": "1"}', None),
    ("set_permission", '{"category": " #e", "level": "act", "cap": #n}', None),
    ("set_permission", '{"category": "#e", "level": "always"}', "level"),
    ("authorize_action", '{"category": "#e ", "description": "pay", "amount": 40.5}', None),
    ("authorize_action", '{"category": "#e", "description": "pay", "amount": "much"}', "type: amount"),
    ("log_action", '{"category": "#e", "description": "done #n", "outcome": "ok"}', None),
    ("record_opportunity", '{"what": "part #n", "aligns_with": "Speed", "reduces_risk": true, "urgency": 1}', None),
    ("resolve_opportunity", '{"contains": "t 1"}', None),
    ("set_profile_field", '{"field": "City", "value": " Bern #n "}', None),
    ("set_profile_field", '{"field": "PIN", "value": "#n"}', None),
    ("forget_profile_field", '{"field": "city"}', None),
    ("add_goal", '{"gaol": "#n"}', "missing: goal"),
    ("log_observation", '{"note": "#e', "args"),
    ("launch", "{}", "tool"),
    ("explain_basis", '{"topic": "#e"}', None),
)


def calls(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, seq, tool, args: every event as a tool call."""
    n = F.col("event_id")
    args = F.replace(F.replace(pick(n, *(c[1] for c in CALLS)), F.lit("#n"), (n % 97).cast("string")), F.lit("#e"), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("owner_id"), n.alias("seq"), pick(n, *(c[0] for c in CALLS)).alias("tool"), args.alias("args"))


def actions(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("owner_id", "seq", F.concat(F.lit(" "), "category").alias("category"), "description", "amount", pick(F.col("seq"), "done", "failed", "asked").alias("outcome"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), "event_type", F.lit(" seen ")).alias("note"), F.when(F.col("event_id") % 2 == 0, F.lit(" Log ")).alias("category"), "ts")


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Line items as opportunities; urgency in steps of 0.05 from -0.1 to 1.1."""
    li, n = table(spark, d, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    urgency = F.when(n % 17 > 0, ((F.col("l_quantity") * 7 + n) % 25).cast("int") / 20 - 0.1)
    aligned = F.when(F.col("l_returnflag") == "R", F.lit("speed > cost")).when(F.col("l_returnflag") == "A", F.lit("  "))
    return li.select((F.col("l_suppkey") % 150).alias("owner_id"), n.alias("seq"), F.concat(F.lit(" part "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("what"), aligned.alias("aligns_with"), F.when(F.col("l_linestatus") == "O", F.lit("ship it")).otherwise("").alias("advances_goal"), (F.col("l_quantity") > 25).alias("reduces_risk"), urgency.alias("urgency"))


def mood_records(spark: SparkSession, scored: DataFrame, d: str) -> DataFrame:
    """Corrections, observations, scored opportunities and what is resolved of them as rows of one stream.

    Of each four owners one resolves nothing, one what is urgent and reduces risks, one what is urgent, one everything.
    """
    e, no = table(spark, d, "events"), lambda kind: F.lit(None).cast(kind)
    said = e.select(F.col("user_id").alias("owner_id"), F.when(F.col("event_id") % 7 == 0, "correction").otherwise("observation").alias("kind"), no("long").alias("id"), no("string").alias("status"), no("boolean").alias("reduces_risk"), F.col("ts").cast("timestamp").alias("ts"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=F.col("seq") % 500)
    found = scored.select("owner_id", F.lit("opportunity").alias("kind"), F.col("seq").alias("id"), "status", "reduces_risk", at.alias("ts"))
    high, quarter = F.col("status") == "interrupt", F.col("owner_id") % 4
    done = found.where((quarter == 1) & high & F.col("reduces_risk") | (quarter == 2) & high | (quarter == 3)).select("owner_id", F.lit("resolved").alias("kind"), "id", no("string").alias("status"), no("boolean").alias("reduces_risk"), "ts")
    return said.unionByName(found).unionByName(done)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as messages, each closed by a template sentence."""
    m, n = table(spark, d, "documents"), F.col("doc_id")
    subject = F.when(n % 4 == 0, F.lit("")).when(n % 4 == 1, F.lit(None).cast("string")).when(n % 4 == 2, F.lit("your click on the cost")).otherwise(" ")
    return m.select((n % 150).alias("owner_id"), n.alias("msg_id"), subject.alias("subject"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(n, *TEMPLATES)).alias("body"))


TOPICS = ("click", "an error on the page", "SIGN", "bolt", "Ring economy", "zzz", "w")


def topics(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, topic_id, topic: two owners share each id, and some topics are null."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    return c.select((n % 150).alias("owner_id"), F.shiftright(n, 1).alias("topic_id"), F.when(n % 11 > 0, pick(n, *TOPICS)).alias("topic"))


def form_labels(spark: SparkSession, d: str) -> DataFrame:
    """A form of each customer: nine labels from LABELS; two owners share each id."""
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    rows = c.select(F.shiftright(n, 1).alias("form_id"), (n % 150).alias("owner_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("pos"))
    return rows.withColumn("label", pick(F.col("form_id") + F.col("owner_id") + F.col("pos"), *LABELS))


ENTRY_LABELS, ENTRY_VALUES = ("First name", "Surname", "Email", "PIN", "City", "Shoe size", "first name"), (" Ada ", "Byron", "ada@example.org", "1234", "Bern", "38", "Grace")


def profile_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = owners(spark, d).select("owner_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("i")).where((F.col("owner_id") + F.col("i")) % 5 > 0)
    return rows.select("owner_id", (F.col("owner_id") * 7 + F.col("i")).alias("seq"), pick(F.col("i"), *ENTRY_LABELS).alias("label"), pick(F.col("i"), *ENTRY_VALUES).alias("value"))


_ORDERS_AMOUNT = "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 13 = 1 THEN -o_totalprice WHEN o_orderkey % 13 = 2 THEN 50000.0 ELSE o_totalprice END"
SQL = {
    "corrections": f"SELECT user_id AS owner_id, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN upper(event_type) ELSE event_type END AS context, {sql_pick('event_id', *HIGHER)} AS higher, {sql_pick('event_id', *LOWER)} AS lower, CASE WHEN event_id % 41 = 0 THEN (event_id % 120)::DOUBLE / 100 END AS confidence, ts FROM events",
    "owners": "SELECT DISTINCT user_id AS owner_id FROM events",
    "facts": "SELECT p_partkey % 150 AS owner_id, p_partkey AS seq, p_name || ' ' || lower(p_type) AS fact, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE 'general' END AS category FROM part",
    "goals": "SELECT o_custkey % 150 AS owner_id, o_orderkey AS seq, 'finish ' || lower(o_orderpriority) || ' order ' || (o_orderkey % 97) AS goal, o_orderstatus = 'O' AS active FROM orders",
    "permission_entries": f"SELECT owner_id, owner_id * 9 + i AS seq, lower(trim({sql_pick('i', ' 1-Urgent', '2-HIGH ', '3-medium', '4-NOT SPECIFIED', '1-URGENT', '2-high')})) AS category, {sql_pick('(owner_id * 9 + i)', *LEVELS_SET)} AS level, CASE WHEN (owner_id * 9 + i) % 4 = 1 THEN 0.0 WHEN (owner_id * 9 + i) % 4 > 1 THEN ((owner_id * 9 + i) % 11 * 50000)::DOUBLE END AS cap FROM owners, range(9) AS r(i)",
    "permissions": "SELECT owner_id, category, arg_max(level, seq) AS level, (arg_max({'c': cap}, seq)).c AS cap, max(seq) AS seq FROM permission_entries WHERE level IN ('observe', 'recommend', 'act') GROUP BY owner_id, category",
    "requests": f"SELECT o_custkey % 150 AS owner_id, o_orderkey AS seq, o_orderpriority AS category, 'order ' || o_orderkey AS description, {_ORDERS_AMOUNT} AS amount FROM orders",
    "decisions": "SELECT r.*, coalesce(p.level, 'recommend') AS level, p.cap, CASE WHEN coalesce(p.level, 'recommend') <> 'act' THEN 'level' WHEN coalesce(r.amount > p.cap, false) THEN 'cap' ELSE 'granted' END AS reason FROM requests r LEFT JOIN permissions p ON r.owner_id = p.owner_id AND lower(trim(r.category)) = p.category",
    "actions": f"SELECT owner_id, seq, lower(category) AS category, description, amount, {sql_pick('seq', 'done', 'failed', 'asked')} AS outcome FROM requests",
    "observations": "SELECT user_id AS owner_id, event_id AS seq, event_type || ' seen' AS note, CASE WHEN event_id % 2 = 0 THEN ' Log ' ELSE 'general' END AS category, ts FROM events",
    "permission_log": f"SELECT o_custkey % 150 AS owner_id, o_orderkey AS seq, lower(o_orderpriority) AS category, {sql_pick('o_custkey', *LEVELS_SET)} AS level, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 11 * 50000)::DOUBLE END AS cap FROM orders WHERE o_orderkey % 7 = 0",
    "decisions_at": "SELECT r.*, coalesce(p.level, 'recommend') AS level, p.cap, CASE WHEN coalesce(p.level, 'recommend') <> 'act' THEN 'level' WHEN coalesce(r.amount > p.cap, false) THEN 'cap' ELSE 'granted' END AS reason FROM (SELECT *, lower(category) AS pcat FROM requests WHERE seq % 7 > 0) r ASOF LEFT JOIN (SELECT * FROM permission_log WHERE level IN ('observe', 'recommend', 'act')) p ON r.owner_id = p.owner_id AND r.pcat = p.category AND r.seq >= p.seq",
    "commands": f"SELECT c_custkey % 150 AS owner_id, c_custkey * CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN {STRIDE[k]}" for i, k in enumerate(NEEDLES)) + f" END AS seq, {sql_pick('c_custkey', *NEEDLES)} AS kind, CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN {sql_pick('(c_custkey // 3)', *NEEDLES[k])}" for i, k in enumerate(NEEDLES)) + " END AS needle, CASE WHEN c_custkey // 3 % 2 = 0 THEN 'late' ELSE 'done' END AS outcome FROM customer",
    "due": "SELECT * FROM commands WHERE needle <> ''",
    "fact_hits": "SELECT f.*, (SELECT min(c.seq) FROM due c WHERE c.kind = 'forget' AND c.owner_id = f.owner_id AND c.seq > f.seq AND contains(lower(f.fact), lower(c.needle))) AS hit FROM facts f",
    "goal_hits": "SELECT g.*, (SELECT min(c.seq) FROM due c WHERE g.active AND c.kind = 'close' AND c.owner_id = g.owner_id AND c.seq > g.seq AND contains(lower(g.goal), lower(c.needle))) AS hit FROM goals g",
    "opportunity_hits": "SELECT o.owner_id, o.seq, x.seq AS hit, x.outcome FROM (SELECT o.*, (SELECT min({'seq': c.seq, 'outcome': c.outcome}) FROM due c WHERE c.kind = 'resolve' AND c.owner_id = o.owner_id AND c.seq > o.seq AND contains(lower(o.what), lower(c.needle))) AS x FROM opportunities o) o",
    "calls": f"SELECT user_id AS owner_id, event_id AS seq, {sql_pick('event_id', *(c[0] for c in CALLS))} AS tool, replace(replace({sql_pick('event_id', *(c[1] for c in CALLS))}, '#n', (event_id % 97)::VARCHAR), '#e', event_type) AS args, nullif({sql_pick('event_id', *(c[2] or '' for c in CALLS))}, '') AS problem FROM events",
    "good_calls": "SELECT owner_id, seq, tool, args::JSON AS j FROM calls WHERE problem IS NULL",
    "call_commands": "SELECT owner_id, seq, tool, lower(j->>'contains') AS needle FROM good_calls WHERE j->>'contains' IS NOT NULL",
    "call_corrections": "SELECT owner_id, seq, j->>'context' AS context, coalesce(j->>'value_protected', j->>'higher') AS higher, coalesce(j->>'value_traded_away', j->>'lower') AS lower, CASE WHEN tool = 'set_priority' THEN 0.6::DOUBLE END AS confidence FROM good_calls WHERE tool IN ('record_correction', 'set_priority')",
    "call_permissions": "SELECT owner_id, seq, lower(trim(j->>'category')) AS category, j->>'level' AS level, (j->>'cap')::DOUBLE AS cap FROM good_calls WHERE tool = 'set_permission'",
    "call_decisions": "SELECT r.*, coalesce(p.level, 'recommend') AS level, p.cap FROM (SELECT owner_id, seq, lower(trim(j->>'category')) AS category, j->>'description' AS description, (j->>'amount')::DOUBLE AS amount FROM good_calls WHERE tool = 'authorize_action') r ASOF LEFT JOIN call_permissions p ON r.owner_id = p.owner_id AND r.category = p.category AND r.seq >= p.seq",
    "raw_opportunities": "SELECT l_suppkey % 150 AS owner_id, l_orderkey * 8 + l_linenumber AS seq, 'part ' || l_partkey AS what, l_returnflag = 'R' AS aligned, l_linestatus = 'O' AS goal, l_quantity > 25 AS risk, CASE WHEN (l_orderkey * 8 + l_linenumber) % 17 > 0 THEN least(greatest((((l_quantity * 7)::BIGINT + l_orderkey * 8 + l_linenumber) % 25) * 5 - 10, 0), 100) ELSE 50 END AS hundredths FROM lineitem",
    "opportunities": "SELECT *, CASE WHEN score >= 75 THEN 'interrupt' WHEN score >= 40 THEN 'brief' ELSE 'hold' END AS status FROM (SELECT owner_id, seq, what, risk, hundredths, 20 + 25 * aligned::INT + 20 * goal::INT + 15 * risk::INT + hundredths // 5 AS score FROM raw_opportunities)",
    "messages": f"SELECT doc_id % 150 AS owner_id, doc_id AS msg_id, [NULL, '', 'your click on the cost', ' '][(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE doc_id % 4 + 1 END)::INT] AS subject, coalesce(text, '') || chr(10) || {sql_pick('doc_id', *TEMPLATES)} AS body FROM documents",
    "topics": f"SELECT c_custkey % 150 AS owner_id, c_custkey // 2 AS topic_id, CASE WHEN c_custkey % 11 > 0 THEN {sql_pick('c_custkey', *TOPICS)} END AS topic FROM customer",
    "form_labels": f"SELECT c_custkey // 2 AS form_id, c_custkey % 150 AS owner_id, pos, {sql_pick('(c_custkey // 2 + c_custkey % 150 + pos)', *LABELS)} AS label FROM customer, range(9) AS r(pos)",
    "profile_entries": f"SELECT owner_id, owner_id * 7 + i AS seq, {sql_pick('i', *ENTRY_LABELS)} AS label, trim({sql_pick('i', *ENTRY_VALUES)}) AS value FROM owners, range(7) AS r(i) WHERE (owner_id + i) % 5 > 0",
}


def with_inputs(sql: str) -> str:
    """sql with the expressions that it names, and those that these name, put before it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in SQL:
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", text) and SQL[name] != text:
                visit(SQL[name])
                order.append(name)

    visit(sql)
    parts = ",\n".join(f"{name} AS ({SQL[name]})" for name in order)
    if not order:
        return sql
    head = re.match(r"\s*WITH (RECURSIVE )?", sql)
    return f"WITH {head[1] or ''}{parts},\n{sql[head.end():]}" if head else f"WITH {parts}\n{sql}"
