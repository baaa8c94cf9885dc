"""As-of joins, containment by index, commands in the log and permissions at their time, against loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import commands, gate, ordered, priorities


@pytest.mark.parametrize("hot", [1_000_000, 7])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_as_of_equals_a_loop(spark, hot, strict, forward):
    """Also with a key that holds most rows, cut into ranges; with ties, nulls, repeats and missing keys."""
    rng = random.Random(hot + strict)
    keys = ["a"] * 12 + ["b", "c", None]
    place = lambda: rng.choice([None, *range(40)])
    left = [(rng.choice(keys), place(), i % 50) for i in range(160)]
    right = [(rng.choice(keys + ["d"]), place(), rng.randrange(9)) for _ in range(60)]
    got = ordered.as_of(spark.createDataFrame(left, "k string, seq long, _held int"), spark.createDataFrame(right, "k string, seq long, v int"), ["k"], "seq", ["v"], strict, forward, hot).collect()

    def found(k, at):
        sign = -1 if forward else 1
        ok = [(sign * s, v) for kk, s, v in right if kk == k and None not in (k, s, at) and (sign * s < sign * at or not strict and s == at)]
        return max(ok)[1] if ok else None

    key = lambda r: tuple(map(str, r))
    assert sorted(((r.k, r.seq, r._held, r.found and r.found.v) for r in got), key=key) == sorted(((k, s, x, found(k, s)) for k, s, x in left), key=key)


def test_as_of_empty(spark):
    left, none = spark.createDataFrame([("a", 1)], "k string, seq long"), spark.createDataFrame([], "k string, seq long")
    assert [r.found for r in ordered.as_of(left, none, ["k"], "seq", ["seq"]).collect()] == [None]
    assert ordered.as_of(none, left, ["k"], "seq", ["seq"]).count() == 0


WORDS = ["ring", "Ring", "RINGS", "é", "É!", "a", "ab", "abc", "", " ", "x" * 3000 + "needle" + "y" * 3000, "needle", "漢字", "字", "🙂", "aaaa", None, "İ"]


def test_containing_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = [(rng.choice([1, 2, None]), rng.choice(WORDS) if rng.random() < 0.5 else " ".join(w for w in rng.choices(WORDS[:9], k=3))) for _ in range(150)]
    needles = [(rng.choice([1, 2, 3, None]), rng.choice(WORDS)) for _ in range(80)]
    n, t = spark.createDataFrame(needles, "owner_id int, needle string"), spark.createDataFrame(texts, "owner_id int, text string")
    got = [(r.owner_id, r.needle, r.text) for r in ordered.containing(n, t).collect()]
    plain = n.distinct().join(t.distinct(), "owner_id").where(F.contains(F.lower("text"), F.lower("needle")))
    assert len(got) == len(set(got)) and set(got) == {(r.owner_id, r.needle, r.text) for r in plain.collect()}
    assert ordered.containing(n.limit(0), t).count() == ordered.containing(n, t.limit(0)).count() == 0


@pytest.mark.parametrize("product", [50_000_000, 0])
def test_basis_by_index_equals_the_product(spark, monkeypatch, product):
    monkeypatch.setattr(priorities, "PRODUCT", product)
    rng = random.Random(4)
    topics = [(rng.randrange(3), i, rng.choice([*WORDS, "spring", "work on the ring"])) for i in range(60)]
    rows = [(rng.randrange(3), i, rng.choice(["ring", "WORK", "any", "General", "", "a", "é", "needle"]), "x", "y", 0.5) for i in range(50)]
    got = priorities.explain_basis(spark.createDataFrame(topics, "owner_id long, topic_id long, topic string"), spark.createDataFrame(rows, "owner_id long, seq long, context string, higher string, lower string, confidence double"), spark.createDataFrame([(o, s, c) for o, s, c, *_ in rows], "owner_id long, seq long, fact string")).collect()
    low = lambda s: s.lower()
    for r in got:
        t = low(r.topic or "")
        own = sorted((s, c) for o, s, c, *_ in rows if o == r.owner_id)
        assert [p.context for p in r.priorities] == [c for _, c in own if t in low(c) or low(c) in t or low(c) in ("any", "all", "general")]
        assert [(f.seq, f.fact) for f in r.facts] == [(s, c) for s, c in own if t in low(c)]
    assert len(got) == 60


def test_one_owner_of_very_many_texts(spark):
    """60,000 topics and as many facts of one owner: 3.6 * 10^9 pairs, of which an index looks at a few."""
    topics = spark.range(60_000).select(F.lit(1).alias("owner_id"), F.col("id").alias("topic_id"), F.concat(F.lit("#"), F.lpad(F.conv(F.col("id") * 7919 % 100_003, 10, 36), 4, "0")).alias("topic"))
    facts = spark.range(60_000).select(F.lit(1).alias("owner_id"), F.col("id").alias("seq"), F.concat(F.lit("it is about #"), F.lpad(F.conv(F.col("id"), 10, 36), 4, "0"), F.lit(" again")).alias("fact"))
    begun = time.time()
    n = priorities.basis_facts(topics, facts).count()
    assert n == len({7919 * i % 100_003 for i in range(60_000)} & set(range(60_000))) and time.time() - begun < 100


ENTRY = "owner_id long, seq long, category string, level string, cap double"


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_permission_in_force_at_the_request(spark, hot):
    rng = random.Random(5)
    log = list(range(300))
    rng.shuffle(log)
    pick = lambda: (rng.choice([1, 1, 1, 2]), rng.choice([" Travel", "travel ", "FOOD"]))
    entries = [(*pick(), s, rng.choice(["act", "recommend", "observe", "never", None]), rng.choice([None, 0.0, 10.0])) for s in log[:90]]
    asked = [(*pick(), s, rng.choice([None, -1.0, 0.0, 10.0, 11.0])) for s in log[90:]]
    got = gate.authorize_at(
        spark.createDataFrame([(o, s, c, "d", a) for o, c, s, a in asked], "owner_id long, seq long, category string, description string, amount double"),
        spark.createDataFrame([(o, s, c, level, cap) for o, c, s, level, cap in entries], ENTRY), hot,
    ).collect()
    norm = lambda c: c.strip().lower()
    want = {}
    for o, c, s, a in asked:
        before = [(q, level, cap) for p, k, q, level, cap in entries if p == o and norm(k) == norm(c) and q <= s and level in gate.LEVELS]
        level, cap = max(before)[1:] if before else ("recommend", None)
        want[s] = (c, level, cap, "level" if level != "act" else "cap" if a is not None and cap is not None and a > cap else "granted")
    assert {r.seq: (r.category, r.level, r.cap, r.reason) for r in got} == want and all(r.allowed == (r.reason == "granted") for r in got)
    assert len({r.reason for r in got}) == 3


def replayed(rows, orders, allow_empty):
    """rows {(owner, seq): text} after each command in turn: who was hit by which, and counts."""
    hit, counts = {}, {}
    for o, s, needle, _ in sorted(orders, key=lambda c: c[1]):
        counts[o, s] = 0
        if needle is None or not needle and not allow_empty:
            continue
        for (ro, rs), text in rows.items():
            if ro == o and rs < s and (ro, rs) not in hit and text is not None and needle.lower() in text.lower():
                hit[ro, rs] = s
                counts[o, s] += 1
    return hit, counts


@pytest.mark.parametrize("allow_empty", [False, True])
def test_commands_replay_in_order(spark, allow_empty):
    rng = random.Random(6)
    seqs = list(range(400))
    rng.shuffle(seqs)
    texts = ["the ring", "Rings and things", "a", "", None, "travel by night", "NIGHT shift", "é"]
    rows = {(rng.choice([1, 1, 1, 2]), s): rng.choice(texts) for s in seqs[:260]}
    orders = [(rng.choice([1, 1, 2, 3]), s, rng.choice(["ring", "NIGHT", "g", "", None, "zzz", "é"]), rng.choice([None, "late"])) for s in seqs[260:320]]
    hit, counts = replayed(rows, orders, allow_empty)
    schema = "owner_id long, seq long, kind string, needle string, outcome string"
    of = lambda kind: spark.createDataFrame([(o, s, kind, n, x) for o, s, n, x in orders], schema)
    every = of("forget").union(of("close")).union(of("resolve"))
    table = lambda name, more="": spark.createDataFrame([(o, s, t) for (o, s), t in rows.items()], f"owner_id long, seq long, {name} string")
    facts = table("fact").withColumn("hits", F.lit(1))
    goals = table("goal").withColumn("active", F.col("seq") >= 0)
    opps = table("what").withColumns({"resolved": F.lit(False), "outcome": F.lit(None).cast("string")})
    how = {"allow_empty": allow_empty}
    assert {(r.owner_id, r.seq) for r in commands.facts_after(facts, every, hot=20, **how).collect()} == set(rows) - set(hit)
    assert {(r.owner_id, r.seq): (r.active, r.closed_by) for r in commands.goals_after(goals, every, **how).collect()} == {k: (k not in hit, hit.get(k)) for k in rows}
    said = {(o, s): x or "done" for o, s, _, x in orders}
    assert {(r.owner_id, r.seq): (r.resolved, r.outcome, r.resolved_by) for r in commands.opportunities_after(opps, every, **how).collect()} == {k: (k in hit, said[k[0], hit[k]] if k in hit else None, hit.get(k)) for k in rows}
    done = commands.command_counts(every, facts, goals, opps, **how).collect()
    assert {(r.owner_id, r.seq, r.kind): r.changed for r in done} == {(*k, kind): n for k, n in counts.items() for kind in ("forget", "close", "resolve")}
    assert commands.refused(every, allow_empty).count() == 3 * sum(n is None or not n and not allow_empty for _, _, n, _ in orders)


def test_commands_leave_closed_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "owner_id long, seq long, kind string, needle string, outcome string")
    one = spark.createDataFrame([(1, 5, "close", "x", None), (1, 6, "resolve", "x", None)], none.schema)
    goals = spark.createDataFrame([(1, 1, "x", False), (1, 2, "x", None), (1, 3, "x", True), (1, 3, "x", True), (1, 9, "x", True)], "owner_id long, seq long, goal string, active boolean")
    got = sorted((r.seq, r.active, r.closed_by) for r in commands.goals_after(goals.where("active IS NOT NULL"), one).collect())
    assert got == [(1, False, None), (3, False, 5), (3, False, 5), (9, True, None)]
    assert commands.goals_after(goals, none).count() == 5 and commands.goals_after(goals.limit(0), one).count() == 0
    opps = spark.createDataFrame([(1, 1, "x", True, "old"), (1, 2, "x", False, None)], "owner_id long, seq long, what string, resolved boolean, outcome string")
    assert sorted((r.seq, r.resolved, r.outcome, r.resolved_by) for r in commands.opportunities_after(opps, one).collect()) == [(1, True, "old", None), (2, True, "done", 6)]


@pytest.mark.parametrize("newest", [False, True])
@pytest.mark.parametrize("hot", [30, 10**6])
def test_places_equal_a_sort(spark, hot, newest):
    """Hot keys cut into ranges, ties of the lead, nulls in lead, order and key, clashing names, an empty table."""
    rng = random.Random(hot)
    rows = [(rng.choice([1, 1, 1, 2, 3]) if i % 40 else None, i if i % 50 else None, rng.choice([0.5, 0.25, None, 0.75]), i) for i in rng.sample(range(600), 600)]
    df = spark.createDataFrame(rows, "owner_id long, seq long, score double, part int")
    for lead in (None, "score"):
        got = {}
        for r in ordered.placed(df, ["owner_id"], "seq", lead, newest, "n", hot).collect():
            got.setdefault(r.owner_id, []).append(r)
        for owner, found in got.items():
            mine = [r for r in rows if r[0] == owner]
            assert [r.place for r in sorted(found, key=lambda r: r.place)] == list(range(1, len(mine) + 1)) and {r.n for r in found} == {len(mine)}
            # Nulls are smallest: first where the smallest are first, last where the largest are.
            sign = -1 if newest else 1
            score = lambda x: 0 if not lead else 9 if x is None else -x
            want = sorted((score(r[2]), sign * (-1 if r[1] is None else r[1])) for r in mine)
            assert [(score(r.score), sign * (-1 if r.seq is None else r.seq)) for r in sorted(found, key=lambda r: r.place)] == want
        assert len(got) == 4
    assert ordered.placed(df.limit(0), ["owner_id"], "seq", "score").collect() == []


def test_first_rows_are_cut_before_the_shuffle(spark):
    """Up to LIMITED rows, tasks keep only the first of a key; beyond it places come by ranges. All limits agree."""
    from millrace.operators import opportunities, records

    df = spark.range(3000).select((F.col("id") % 2).alias("owner_id"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("score"), F.lit(False).alias("resolved"))
    for few in (records.newest(df, 5), opportunities.pending(df, 5)):
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") and "Partial" in plan
    assert {r.seq for r in records.newest(df, 1200).where("owner_id = 0").collect()} == {x for x in range(0, 3000, 2)} - set(range(0, 600, 2))
    assert records.newest(df, 0).count() == 3000 and records.newest(df, -1499).select("owner_id", "seq").collect() != []
    assert sorted(r.seq for r in records.newest(df, -1499).collect()) == [2998, 2999] and records.newest(df, -1500).count() == 0
    assert opportunities.pending(df, 1100).where("place = 1100").count() == 2


def test_long_lists_are_dealt_out_among_equal_topics(spark):
    """No task makes more than `pairs` entries of equal topics; those without any and null owners and ids are kept."""
    topics = [(1, i, "") for i in range(300)] + [(1, 300 + i, "none") for i in range(40)] + [(2, 1, None), (None, 7, "x"), (2, None, "x"), (None, None, None)]
    topics = spark.createDataFrame(topics, "owner_id long, topic_id long, topic string")
    facts = spark.createDataFrame([(o, i, f"fact {i}") for o in (1, 2) for i in range(60)], "owner_id long, seq long, fact string")
    held = spark.createDataFrame([(1, 1, "c", "a", "b", 0.5)], "owner_id long, seq long, context string, higher string, lower string, confidence double")
    got = priorities.explain_basis(topics, held, facts, pairs=1_000)
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(got) == whole(priorities.explain_basis(topics, held, facts)) and got.count() == 344
    each = got.groupBy(F.spark_partition_id()).agg(F.sum(F.size("facts")).alias("n")).collect()
    assert sum(r.n for r in each) == 301 * 60 and max(r.n for r in each) <= 4_000


@pytest.mark.parametrize("pairs", [1 << 23, 50])
def test_basis_is_dealt_out_where_it_makes_many_rows(spark, pairs):
    """Equal topics of one owner in slices, null owners, ids and topics: the same pairs; over `pairs` a given number of partitions."""
    topics = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("owner_id"), F.when(F.col("id") % 41 > 0, F.col("id")).alias("topic_id"), F.when(F.col("id") % 7 > 0, F.lit("ring")).alias("topic"))
    facts = spark.range(60).select((F.col("id") % 3).alias("owner_id"), F.col("id").alias("seq"), F.when(F.col("id") % 2 > 0, F.lit("a Ring")).otherwise("none").alias("fact"))
    got = priorities.basis_facts(topics, facts, pairs)
    plain = topics.join(facts, "owner_id").where(F.contains(F.lower("fact"), F.coalesce("topic", F.lit(""))))
    key = lambda r: (r.owner_id, r.topic_id or -1, r.seq)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect())) and plain.count() > 3000
    assert (got.rdd.getNumPartitions() > 40) == (pairs == 50)


def test_lists_are_not_shuffled_for_each_topic(spark):
    """An owner's equal topics share one list: the shuffles of 20,000 topics with 300 facts each stay small. Rows of one id are one topic."""
    from millrace.operators import forms

    topics = spark.range(20_000).select(F.lit(1).alias("owner_id"), F.col("id").alias("topic_id"), F.lit("ring").alias("topic"))
    facts = spark.range(300).select(F.lit(1).alias("owner_id"), F.col("id").alias("seq"), F.concat(F.lit("ring "), F.sha2(F.col("id").cast("string"), 256)).alias("fact"))
    held = spark.createDataFrame([(1, 1, "ring", "a", "b", 0.9)], "owner_id long, seq long, context string, higher string, lower string, confidence double")
    maps = spark.createDataFrame([(1, {"full_name": "Ada"})], "owner_id long, profile map<string,string>")
    done = forms.draft_guidance(topics, held, facts, maps)
    assert done.agg(F.sum(F.size("facts")), F.sum(F.size("priorities")), F.min("signer")).first()[:] == (6_000_000, 20_000, "Ada")
    text = done._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert "<=>" in joins[0]  # what meets the topics last is the lists
    twice = spark.createDataFrame([(1, 5, "ring"), (1, 5, "zzz"), (1, 5, "ring"), (1, None, "ring"), (None, 6, "ring")], "owner_id long, topic_id long, topic string")
    got = {(r.owner_id, r.topic_id, r.topic): len(r.facts) for r in priorities.explain_basis(twice, held, facts).collect()}
    assert got == {(1, 5, "ring"): 600, (1, 5, "zzz"): 600, (1, None, "ring"): 0, (None, 6, "ring"): 0}


@pytest.mark.parametrize("few", [32, 1, 0])
def test_commands_by_stretches_and_by_index(spark, few):
    """Many commands of few needles, several at one place (the smallest by outcome counts), rows of one place, owners of either kind."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(300)]), rng.choice(["ab", "Bc", "abc", None, ""]), i) for i in range(600)]
    orders = [(rng.choice([1, 1, 2]) if i % 30 else None, rng.randrange(0, 310, 2), rng.choice(["a", "B", "c", "BC"]), rng.choice(["x", "y", None])) for i in range(180)] + [(4, 1, "a", "x")]
    orders = [(o, s, n if o != 2 else "b", x) for o, s, n, x in orders]
    got = commands.with_hits(
        spark.createDataFrame(rows, "owner_id long, seq long, what string, stretch int"),
        spark.createDataFrame(orders, "owner_id long, seq long, needle string, outcome string"), "what", few=few,
    ).collect()
    meets = lambda o, s, t: [(q, x or "done") for p, q, n, x in orders if None not in (o, s, t) and p == o and q > s and n.lower() in t.lower()]
    assert {r.stretch: r.hit and tuple(r.hit) for r in got} == {i: min(meets(o, s, t), default=None) for o, s, t, i in rows}
    assert len(got) == 600


@pytest.mark.parametrize("most", [1, 2, 7, 8, 9])
def test_places_among_ends_by_as_few_halvings_as_they_need(spark, most):
    ends = sorted(random.Random(most).choices(range(12), k=most))
    df = spark.range(-1, 14).withColumn("ends", F.when(F.col("id") < 13, F.array(*map(F.lit, ends))))
    got = {r.id: r.n for r in df.select("id", commands._reached(F.col("ends"), F.col("id"), most).alias("n")).collect()}
    assert got == {i: sum(e <= i for e in ends) if i < 13 else 0 for i in range(-1, 14)}


def test_lists_of_many_commands_are_broadcast_and_gone_through_once(spark, monkeypatch):
    """120,000 commands fit the bytes that may be broadcast, so no row is shuffled; beyond these, rows that no list is for are dealt out."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(keep, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        orders = spark.range(120_000).select(F.lit(1).alias("owner_id"), F.col("id").alias("seq"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("needle"), F.lit("x").alias("outcome"))
        # All rows of owner 2, who has no commands, and those of owner 1 after the last command.
        rows = spark.range(8_000).select((F.col("id") % 2 + 1).alias("owner_id"), (F.col("id") + 116_000).alias("seq"), F.lit("B").alias("what"))
        plan = commands.with_hits(rows, orders, "what")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("filter(_list") == 1 and "rightHint=(strategy=broadcast)" in next(line for line in plan.splitlines() if "Join" in line)
        monkeypatch.setattr(commands, "BROADCAST_LISTS", 0)
        got = commands.with_hits(rows, orders, "what").withColumn("part", F.spark_partition_id()).collect()
        assert {r.seq: r.hit and r.hit.seq for r in got} == {116_000 + i: None if i % 2 or i > 3998 else 116_000 + i + 1 for i in range(8_000)}
        most = max(sum(r.part == p and r.owner_id == 2 for r in got) for p in range(4))
        assert len(got) == 8_000 and most < 1_500
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
