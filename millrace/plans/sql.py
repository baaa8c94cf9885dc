"""The same queries in DuckDB SQL, over the derived inputs of plans.inputs."""

from __future__ import annotations

from millrace.functions import labels as L
from millrace.operators import triage as T
from millrace.operators.opportunities import BRIEF, INTERRUPT
from millrace.operators.priorities import STATES, TABLE
from millrace.plans.inputs import NAMES, sql_pick, with_inputs

AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_KEY = "owner_id, lower(context), least(lower(higher), lower(lower)), greatest(lower(higher), lower(lower))"


def fold(source: str, order: str = "seq") -> str:
    """Common table expressions up to `priorities`."""
    return f"""n AS (SELECT owner_id, seq, context, higher, lower, lower(context) AS ckey, least(lower(higher), lower(lower)) AS a, greatest(lower(higher), lower(lower)) AS b,
  (lower(higher) > lower(lower))::INT AS dir, CASE WHEN confidence IS NOT NULL THEN round(least(greatest(confidence, 0.05), 0.99) * 100)::INT END AS conf, row_number() OVER (PARTITION BY {_KEY} ORDER BY {order}) AS i FROM {source}),
f AS (SELECT owner_id, ckey, a, b, i, 1 + 101 * dir + coalesce(conf, 55) AS state, 1::BIGINT AS evidence, seq AS setter FROM n WHERE i = 1
  UNION ALL SELECT owner_id, ckey, a, b, i + 1, t, evidence + (conf IS NULL)::INT, CASE WHEN conf IS NOT NULL OR (t - 1) // 101 <> (state - 1) // 101 THEN seq ELSE setter END
  FROM (SELECT f.*, n.conf, n.seq, CASE WHEN n.conf IS NULL THEN {TABLE}[n.dir * {STATES} + f.state + 1] ELSE 1 + 101 * n.dir + n.conf END AS t
    FROM f JOIN n ON n.owner_id = f.owner_id AND n.ckey = f.ckey AND n.a = f.a AND n.b = f.b AND n.i = f.i + 1)),
z AS (SELECT owner_id, ckey, a, b, arg_max(state, i) AS state, arg_max(evidence, i) AS evidence, arg_max(setter, i) AS setter FROM f GROUP BY ALL),
priorities AS (SELECT z.owner_id, n.seq, n.context, m.higher, m.lower, ((state - 1) % 101)::INT AS confidence, evidence
  FROM z JOIN n ON n.owner_id = z.owner_id AND n.ckey = z.ckey AND n.a = z.a AND n.b = z.b AND n.i = 1 JOIN n AS m ON m.owner_id = z.owner_id AND m.seq = z.setter)"""


FOLD = "WITH RECURSIVE " + fold("corrections")
_ARRIVED = "WITH RECURSIVE " + fold("corrections", "seq // 3 % 5, seq")
_TOPICAL = "(contains(lower(p.context), lower(coalesce(t.topic, ''))) OR contains(lower(coalesce(t.topic, '')), lower(p.context)) OR lower(p.context) IN ('any', 'all', 'general'))"
_PLACE = "row_number() OVER (PARTITION BY {} ORDER BY {})"


def held(topics: str, facts: bool = True) -> str:
    """Common table expressions of what bears on each topic."""
    tail = ", bf AS (SELECT t.owner_id, t.topic_id, f.seq, f.fact FROM topics t JOIN facts f ON t.owner_id = f.owner_id AND contains(lower(f.fact), lower(coalesce(t.topic, ''))))" if facts else ""
    return f"{FOLD}, bp AS (SELECT t.topic_id, p.*, {_PLACE.format('t.owner_id, t.topic_id', 'p.confidence DESC, p.seq')} AS place FROM {topics} t JOIN priorities p ON t.owner_id = p.owner_id AND {_TOPICAL}){tail}"


# ---- labels


def cleaned(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g')"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def field(x: str) -> str:
    exact, inside = [(k, k) for k in L.ALIASES], []
    for key, names in L.ALIASES.items():
        exact += [(n, key) for n in (key.replace("_", " "), *names)]
        inside += [(n, key) for n in names]
    pairs = lambda xs: "[" + ", ".join(f"{{'a': '{a}', 'k': '{k}'}}" for a, k in xs) + "]"
    return f"coalesce(list_filter({pairs(exact)}, lambda v: v.a = {cleaned(x)})[1].k, list_filter({pairs(inside)}, lambda v: contains({cleaned(x)}, v.a))[1].k)"


def sensitive(x: str) -> str:
    return f"(len(list_filter({quoted(L.SENSITIVE)}, lambda v: contains(lower({x}), v))) > 0)"


def slot(x: str) -> str:
    cases = " ".join(f"WHEN len(list_filter({quoted(parts)}, lambda v: contains({slug(x)}, v))) > 0 THEN '{name}'" for name, parts in L.SLOTS)
    return f"(CASE {cases} WHEN {slug(x)} <> '' THEN {slug(x)}[1:40] ELSE 'secret' END)"


def stored(x: str) -> str:
    return f"(CASE WHEN list_contains({quoted(NAMES)}, {slot(x)}) THEN {slot(x)} ELSE list_filter({quoted(NAMES)}, lambda v: contains({slug(x)}, v) OR contains(v, {slug(x)}))[1] END)"


#: Labels are few: each is mapped once.
_LABELLED = f"lab AS (SELECT label, {field('label')} AS field, {sensitive('label')} AS hidden, {slot('label')} AS slot, {stored('label')} AS held FROM (SELECT DISTINCT label FROM form_labels))"
_ENTRIES = f"ent AS (SELECT label, coalesce({field('label')}, replace(trim(lower(label)), ' ', '_')) AS field FROM (SELECT DISTINCT label FROM profile_entries))"
_FIELDS = f"{_ENTRIES}, fields AS (SELECT p.owner_id, e.field, arg_max(p.value, p.seq) AS value FROM profile_entries p JOIN ent e USING (label) WHERE NOT {sensitive('p.label')} AND NOT {sensitive('e.field')} GROUP BY ALL)"
_CLASSIFIED = f"""{_LABELLED}, {_FIELDS}, whole AS (SELECT a.owner_id, a.value || ' ' || b.value AS name FROM fields a JOIN fields b USING (owner_id) WHERE a.field = 'first_name' AND b.field = 'last_name' AND a.value <> '' AND b.value <> ''),
marked AS (SELECT l.owner_id, l.form_id, l.pos, l.label, b.hidden, b.slot, CASE WHEN b.hidden THEN 'vault:' || b.held ELSE coalesce(f.value, CASE WHEN b.field = 'full_name' THEN w.name END) END AS value
  FROM form_labels l JOIN lab b USING (label) LEFT JOIN fields f ON f.owner_id = l.owner_id AND f.field = b.field LEFT JOIN whole w ON w.owner_id = l.owner_id)"""
_VALUE = sql_pick("(form_id + pos)", "plain", " vault:card_number ", "VAULT:nothing", "vault:bad name")
_REFERENCE = f"regexp_matches(trim({_VALUE}), '{L.REFERENCE}')"

# ---- triage


def fired(signals, x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{s.regex}') THEN '{s.name}' END" for s in signals) + "], lambda v: v IS NOT NULL)"


def weight(signals, x: str) -> str:
    weights = "MAP {" + ", ".join(f"'{s.name}': {s.weight}" for s in signals) + "}"
    return f"least(coalesce(list_sum(list_transform({x}, lambda v: {weights}[v])), 0), 100)::INT"


_TRIAGE = f"""WITH m AS (SELECT msg_id, coalesce(subject, '') || chr(10) || coalesce(body, '') AS text FROM messages),
r AS (SELECT msg_id, {fired(T.SCAM, 'lower(text)')} AS scam, {fired(T.BILLING, 'lower(text)')} AS billing, regexp_extract_all(text, '{T.MONEY}', 0, 'i')[1:{T.SHOWN}] AS money, regexp_extract_all(text, '{T.DEADLINE}', 0, 'i')[1:{T.SHOWN}] AS deadlines FROM m),
w AS (SELECT *, {weight(T.SCAM, 'scam')} AS scam_score, {weight(T.BILLING, 'billing')} AS billing_score FROM r),
v AS (SELECT *, CASE WHEN scam_score >= {T.LIKELY} THEN 'likely_scam' WHEN scam_score >= {T.SUSPICIOUS} THEN 'suspicious' WHEN billing_score >= {T.WATCH} THEN 'money_watch' WHEN len(money) + len(deadlines) > 0 THEN 'needs_decision' ELSE 'routine' END AS verdict FROM w)"""

_ADVICE = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ADVICE.items()) + " END"

# ---- views

_LAST = lambda t, n: f"(SELECT * FROM (SELECT *, {_PLACE.format('owner_id', 'seq DESC')} AS place FROM {t}) WHERE place <= {n})"
_TOP = f"(SELECT * FROM (SELECT *, {_PLACE.format('owner_id', 'score DESC, seq')} AS place FROM opportunities) WHERE place <= 10)"
_LIST = lambda t, x, order: f"(SELECT owner_id, string_agg({x}, ';' ORDER BY {order}) AS x FROM {t} GROUP BY owner_id)"


def states(opps: str, learned: str) -> str:
    return f"""SELECT o.owner_id, CASE WHEN p.risk THEN 'protective' WHEN p.high THEN 'charged' WHEN p.brief THEN 'curious' WHEN c.learned THEN 'happy' WHEN b.noticed THEN 'thinking' ELSE 'calm' END AS mood
  FROM owners o LEFT JOIN (SELECT owner_id, bool_or(risk AND status = 'interrupt') AS risk, bool_or(status = 'interrupt') AS high, bool_or(status = 'brief') AS brief FROM opportunities WHERE {opps} GROUP BY owner_id) p USING (owner_id)
  LEFT JOIN (SELECT owner_id, bool_or(ts > {AS_OF} - INTERVAL 48 HOUR) AS learned FROM corrections WHERE {learned} GROUP BY owner_id) c USING (owner_id)
  LEFT JOIN (SELECT owner_id, bool_or(ts > {AS_OF} - INTERVAL 24 HOUR) AS noticed FROM observations GROUP BY owner_id) b USING (owner_id)"""


_COUNTED = "(SELECT owner_id, count(*) AS n FROM corrections WHERE confidence IS NULL GROUP BY owner_id)"
_GOALS = _LIST("(SELECT * FROM goals WHERE active)", "goal", "seq")



def _called(tool: str, row: str, text: str) -> str:
    """The first call of a tool after a row whose needle the row's text holds."""
    return f"(SELECT min(c.seq) FROM call_commands c WHERE c.tool = '{tool}' AND c.owner_id = {row}.owner_id AND c.seq > {row}.seq AND contains(lower({row}.j->>'{text}'), c.needle))"


assert (BRIEF, INTERRUPT) == ("0.40", "0.75")  # the bars in plans.inputs
ORACLE = {
    "priorities_fold": f"{FOLD} SELECT * FROM priorities",
    "priorities_stream": f"{FOLD} SELECT * FROM priorities",
    "priorities_arrivals": f"{_ARRIVED} SELECT * FROM priorities",
    "priorities_changed": f"{_ARRIVED} SELECT p.* FROM priorities p JOIN n k ON k.owner_id = p.owner_id AND k.seq = p.seq WHERE (k.owner_id, k.ckey, k.a, k.b) IN (SELECT (owner_id, ckey, a, b) FROM n WHERE seq // 3 % 5 = 4)",
    "priorities_set": f"WITH RECURSIVE {fold('(SELECT * FROM corrections WHERE confidence IS NOT NULL)')} SELECT * FROM priorities",
    "priority_lookup": f"{FOLD} SELECT o.owner_id, p.seq, p.higher, p.lower, p.confidence FROM owners o LEFT JOIN priorities p ON o.owner_id = p.owner_id AND lower(p.context) = 'click' AND least(lower(p.higher), lower(p.lower)) = 'cost' AND greatest(lower(p.higher), lower(p.lower)) = 'speed'",
    "priorities_for": f"{FOLD} SELECT owner_id, seq, context, confidence, {_PLACE.format('owner_id', 'confidence DESC, seq')} AS place FROM priorities WHERE contains(lower(context), 'ic') OR lower(context) IN ('any', 'all', 'general')",
    "basis_priorities": f"{held('topics', False)} SELECT owner_id, topic_id, place, context, higher, confidence FROM bp",
    "basis_facts": "SELECT t.owner_id, t.topic_id, f.seq, f.fact FROM topics t JOIN facts f ON t.owner_id = f.owner_id AND contains(lower(f.fact), lower(coalesce(t.topic, '')))",
    "explain_basis": f"{held('topics')} SELECT t.owner_id, t.topic_id, coalesce(p.x, '') AS priorities, coalesce(f.x, '') AS facts FROM topics t LEFT JOIN (SELECT owner_id, topic_id, string_agg(higher || '>' || lower, ';' ORDER BY place) AS x FROM bp GROUP BY ALL) p USING (owner_id, topic_id) LEFT JOIN (SELECT owner_id, topic_id, string_agg(fact, ';' ORDER BY seq) AS x FROM bf GROUP BY ALL) f USING (owner_id, topic_id)",
    "corrections_count": "SELECT owner_id, count(*) AS n FROM corrections WHERE confidence IS NULL GROUP BY owner_id",
    "facts_remember": "SELECT owner_id, seq, fact, category FROM facts",
    "facts_remember_once": "SELECT owner_id, min(seq) AS seq, category AS fact FROM facts GROUP BY owner_id, category",
    "facts_forget": "SELECT owner_id, seq, fact FROM facts WHERE NOT contains(lower(fact), 'ring')",
    "facts_forget_count": "SELECT owner_id, count(*) FILTER (contains(lower(fact), 'ring')) AS removed FROM facts GROUP BY owner_id",
    "goals_add": "SELECT owner_id, seq, goal, true AS active FROM goals",
    "goals_close": "SELECT owner_id, seq, active AND NOT contains(goal, 'high') AS active, active AND contains(goal, 'high') AS closed FROM goals",
    "goals_close_count": "SELECT owner_id, count(*) FILTER (active AND contains(goal, 'high')) AS closed FROM goals GROUP BY owner_id",
    "goals_active": "SELECT owner_id, seq, goal FROM goals WHERE active",
    "observations_log": "SELECT owner_id, seq, note, category FROM observations",
    "observations_newest": f"SELECT owner_id, seq, place FROM {_LAST('observations', 5)}",
    "permissions_current": "SELECT * FROM permissions",
    "permissions_audit": "SELECT owner_id, seq, category, level, cap, 'permission_change' AS outcome FROM permission_entries WHERE level <> 'always'",
    "permissions_rejected": "SELECT owner_id, seq, level FROM permission_entries WHERE level = 'always'",
    "permission_lookup": "SELECT owner_id, seq, level, cap FROM decisions",
    "gate_authorize": "SELECT owner_id, seq, category, level, cap, reason, reason = 'granted' AS allowed FROM decisions",
    "gate_denials": "SELECT owner_id, seq, lower(category) AS category, description, amount, level, cap, 'denied: ' || reason AS outcome FROM decisions WHERE reason <> 'granted'",
    "actions_log": "SELECT * FROM actions",
    "actions_newest": f"SELECT owner_id, seq, category, place FROM {_LAST('actions', 10)}",
    "actions_all": f"SELECT owner_id, seq, {_PLACE.format('owner_id', 'seq DESC')} AS place FROM actions",
    "actions_but_oldest": f"SELECT owner_id, seq, place FROM (SELECT owner_id, seq, {_PLACE.format('owner_id', 'seq DESC')} AS place, {_PLACE.format('owner_id', 'seq')} AS age FROM actions) WHERE age > 3",
    "opportunities_score": "SELECT owner_id, seq, what, score, status FROM opportunities",
    "gate_authorize_at": "SELECT owner_id, seq, category, level, cap, reason, reason = 'granted' AS allowed FROM decisions_at",
    "gate_denials_at": "SELECT owner_id, seq, lower(category) AS category, description, amount, level, cap, 'denied: ' || reason AS outcome FROM decisions_at WHERE reason <> 'granted'",
    "facts_forget_log": "SELECT owner_id, seq, fact FROM fact_hits WHERE hit IS NULL",
    "goals_close_log": "SELECT owner_id, seq, active AND hit IS NULL AS active, hit AS closed_by FROM goal_hits",
    "opportunities_resolve_log": "SELECT owner_id, seq, hit IS NOT NULL AS resolved, outcome, hit AS resolved_by FROM opportunity_hits",
    "commands_counts": "SELECT c.owner_id, c.seq, c.kind, c.needle, count(h.hit) AS changed FROM commands c LEFT JOIN (SELECT owner_id, hit, 'forget' AS kind FROM fact_hits UNION ALL SELECT owner_id, hit, 'close' FROM goal_hits UNION ALL SELECT owner_id, hit, 'resolve' FROM opportunity_hits) h ON h.owner_id = c.owner_id AND h.hit = c.seq AND h.kind = c.kind GROUP BY ALL",
    "opportunities_resolve": "SELECT owner_id, seq, contains(what, 'part 1') AS resolved, CASE WHEN contains(what, 'part 12') THEN 'done' WHEN contains(what, 'part 1') THEN 'late' END AS outcome FROM opportunities",
    "opportunities_resolve_count": "SELECT owner_id, count(*) FILTER (contains(what, 'part 12')) AS resolved FROM opportunities GROUP BY owner_id",
    "opportunities_pending": f"SELECT owner_id, seq, score, {_PLACE.format('owner_id', 'score DESC, seq')} AS place FROM opportunities WHERE NOT contains(what, 'part 12')",
    "opportunities_top": f"SELECT owner_id, seq, place FROM {_TOP}",
    "triage_messages": f"{_TRIAGE} SELECT msg_id, array_to_string(scam, ';') AS scam_flags, array_to_string(billing, ';') AS billing_flags, array_to_string(money, ';') AS money, array_to_string(deadlines, ';') AS deadlines, scam_score, billing_score, verdict, {_ADVICE} AS advice FROM v",
    "triage_verdicts": f"{_TRIAGE} SELECT verdict, count(*) AS n FROM v GROUP BY verdict",
    "triage_priorities": f"{held(f'''(SELECT owner_id, msg_id AS topic_id, CASE WHEN coalesce(subject, '') <> '' THEN subject ELSE body[1:{T.TOPIC_CHARS}] END AS topic FROM messages)''', False)} SELECT owner_id, topic_id AS msg_id, context, higher, confidence, place FROM bp",
    "labels_normalize": f"WITH {_LABELLED} SELECT owner_id, form_id, pos, field, hidden AS is_sensitive, slot, held FROM form_labels JOIN lab USING (label)",
    "profile_fields": f"WITH {_FIELDS} SELECT * FROM fields",
    "profile_forget": f"WITH {_FIELDS} SELECT owner_id, max(field) FILTER (field = 'first_name') AS removed, coalesce(string_agg(field, ',' ORDER BY field) FILTER (field <> 'first_name'), '') AS fields FROM fields GROUP BY owner_id",
    "forms_classify": f"WITH {_CLASSIFIED} SELECT owner_id, form_id, pos, label, value, CASE WHEN value IS NULL THEN CASE WHEN hidden THEN 'sensitive' ELSE 'unknown' END END AS why, CASE WHEN value IS NULL AND hidden THEN slot END AS slot FROM marked",
    "forms_fill": f"WITH {_CLASSIFIED}, d AS (SELECT owner_id, form_id, string_agg(label || '=' || value, ',' ORDER BY label) AS filled, count(*) AS k FROM (SELECT DISTINCT owner_id, form_id, label, value FROM marked WHERE value IS NOT NULL) GROUP BY ALL) SELECT m.owner_id, m.form_id, coalesce(any_value(filled), '') AS filled, coalesce(string_agg(label, ',' ORDER BY pos) FILTER (value IS NULL), '') AS needs_you, coalesce(any_value(k), 0) || '/' || count(*) AS coverage FROM marked m LEFT JOIN d ON d.owner_id = m.owner_id AND d.form_id = m.form_id GROUP BY m.owner_id, m.form_id",
    "forms_refused": f"SELECT owner_id, form_id, pos, {sensitive('label')} AND NOT {_REFERENCE} AS blocked, {_REFERENCE} AND NOT list_contains({quoted(NAMES)}, regexp_extract(trim({_VALUE}), '(?i)^vault:(.*)$', 1)) AS missing FROM form_labels",
    "references": f"SELECT owner_id, form_id, pos, {_REFERENCE} AS is_reference FROM form_labels",
    "draft_guidance": f"{held('topics')}, {_FIELDS}, s AS (SELECT owner_id, nullif(trim(coalesce(max(value) FILTER (field = 'first_name'), '') || ' ' || coalesce(max(value) FILTER (field = 'last_name'), '')), '') AS signer FROM fields GROUP BY owner_id) SELECT t.owner_id, t.topic_id, (SELECT count(*) FROM bp WHERE bp.topic_id = t.topic_id AND bp.owner_id = t.owner_id)::INT AS n_priorities, (SELECT count(*) FROM bf WHERE bf.topic_id = t.topic_id AND bf.owner_id = t.owner_id)::INT AS n_facts, s.signer FROM topics t LEFT JOIN s USING (owner_id)",
    "owner_states": states("true", "confidence IS NULL"),
    "owner_states_stream": """WITH now AS (SELECT max(ts) AS t FROM events),
  said AS (SELECT user_id AS owner_id, bool_or(event_id % 7 = 0 AND ts > t - INTERVAL 48 HOUR) AS learned, bool_or(event_id % 7 > 0 AND ts > t - INTERVAL 24 HOUR) AS noticed FROM events, now GROUP BY user_id),
  opps AS (SELECT owner_id, min(CASE WHEN status = 'interrupt' AND risk THEN CASE WHEN owner_id % 4 = 0 THEN 0 END WHEN status = 'interrupt' THEN CASE WHEN owner_id % 4 < 2 THEN 1 END WHEN status = 'brief' AND owner_id % 4 < 3 THEN 2 END) AS best FROM opportunities GROUP BY owner_id)
  SELECT owner_id, CASE best WHEN 0 THEN 'protective' WHEN 1 THEN 'charged' WHEN 2 THEN 'curious' ELSE CASE WHEN learned THEN 'happy' WHEN noticed THEN 'thinking' ELSE 'calm' END END AS mood FROM said FULL JOIN opps USING (owner_id)""",
    "daily_brief": f"WITH st AS ({states('true', 'confidence IS NULL')}) SELECT st.owner_id, mood, coalesce(g.x, '') AS active_goals, coalesce(p.x, '') AS opportunities, coalesce(a.x, '') AS recent_actions, coalesce(b.x, '') AS recent_observations, coalesce(c.n, 0) AS corrections_learned_from FROM st LEFT JOIN {_GOALS} g USING (owner_id) LEFT JOIN {_LIST(_TOP, 'what', 'place')} p USING (owner_id) LEFT JOIN {_LIST(_LAST('actions', 10), 'outcome', 'place')} a USING (owner_id) LEFT JOIN {_LIST(_LAST('observations', 5), 'note', 'place')} b USING (owner_id) LEFT JOIN {_COUNTED} c USING (owner_id)",
    "snapshot": f"{FOLD} SELECT o.owner_id, coalesce(p.x, '') AS priorities, coalesce(f.x, '') AS facts, coalesce(g.x, '') AS active_goals, coalesce(c.n, 0) AS corrections_learned_from FROM owners o LEFT JOIN {_LIST('priorities', 'context', 'confidence DESC, seq')} p USING (owner_id) LEFT JOIN {_LIST('facts', 'fact', 'seq')} f USING (owner_id) LEFT JOIN {_GOALS} g USING (owner_id) LEFT JOIN {_COUNTED} c USING (owner_id)",
    "calls_rejected": "SELECT owner_id, seq, tool, problem FROM calls WHERE problem IS NOT NULL",
    "calls_priorities": f"WITH RECURSIVE {fold('call_corrections')} SELECT * FROM priorities",
    "calls_facts": f"SELECT owner_id, seq, trim(j->>'fact') AS fact, coalesce(j->>'category', 'general') AS category FROM good_calls f WHERE tool = 'remember_fact' AND {_called('forget', 'f', 'fact')} IS NULL",
    "calls_goals": f"SELECT owner_id, seq, j->>'goal' AS goal, {_called('close_goal', 'g', 'goal')} IS NULL AS active, {_called('close_goal', 'g', 'goal')} AS closed_by FROM good_calls g WHERE tool = 'add_goal'",
    "calls_actions": "SELECT owner_id, seq, lower(j->>'category') AS category, j->>'description' AS description, NULL::DOUBLE AS amount, j->>'outcome' AS outcome FROM good_calls WHERE tool = 'log_action' UNION ALL SELECT owner_id, seq, category, NULL, NULL, 'permission_change' FROM call_permissions UNION ALL SELECT owner_id, seq, category, description, amount, CASE WHEN level <> 'act' THEN 'denied: level' ELSE 'denied: cap' END FROM call_decisions WHERE level <> 'act' OR coalesce(amount > cap, false)",
    "calls_opportunities": f"SELECT owner_id, seq, j->>'what' AS what, 80 AS score, {_called('resolve_opportunity', 'o', 'what')} IS NOT NULL AS resolved, CASE WHEN {_called('resolve_opportunity', 'o', 'what')} IS NOT NULL THEN 'done' END AS outcome FROM good_calls o WHERE tool = 'record_opportunity'",
    "calls_profile": "SELECT owner_id, 'city' AS field, trim(arg_max(v, seq)) AS value FROM (SELECT owner_id, seq, coalesce(j->>'value', '') AS v FROM good_calls WHERE tool IN ('set_profile_field', 'forget_profile_field') AND lower(j->>'field') = 'city') GROUP BY owner_id HAVING arg_max(v, seq) <> ''",
    "store_saved": "SELECT owner_id::VARCHAR AS owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY seq) - 1 AS seq, goal, active FROM goals WHERE active",
    "store_loaded": "SELECT owner_id::VARCHAR AS owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY seq) - 1 AS seq, fact, category FROM facts WHERE owner_id % 7 > 0",
    "store_broken": "SELECT DISTINCT owner_id::VARCHAR AS store_path, 9 AS n FROM facts WHERE owner_id % 7 = 0",
    "store_appended": "SELECT owner_id, count(*) AS n, max(seq) AS last FROM corrections GROUP BY owner_id",
}
ORACLE = {name: with_inputs(sql) for name, sql in ORACLE.items()}
