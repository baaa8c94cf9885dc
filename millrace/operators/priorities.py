"""Priorities learned from corrections and declarations, and what they say about a topic.

A priority belongs to an owner, a context and an unordered pair of values (letters in either
case). Its state is a direction and a confidence in hundredths; a correction reinforces or erodes it
and may turn it round, a declaration sets it. The transition is a table of 2 x 203 states built by
the rounding rule, so executors do no float arithmetic.

Events: owner_id, seq, context, higher, lower, confidence (double; null for a correction). seq is unique
within an owner and orders the events. A confidence is held to 0.05 to 0.99 and rounded to hundredths.
Ids of topics and the like are an owner's own: equal ids of two owners have nothing to do with each other.
A null topic counts as an empty one, which is in every context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import generic, holds
from millrace.operators.ordered import containing
from millrace.sources.shared import settled, small

# Learning rates, the flip threshold, first confidences.
REINFORCE, CONTRADICT, FLIP_BELOW = 0.15, 0.30, 0.25
FIRST, TURNED = 55, 50
#: Runs of a key's events that are folded on their own: 2^16 numbers wide, then 2^12 runs together, as far as seqs reach.
RUN_BITS = (16, 28, 40, 52)
#: Events up to which a run stays a list; a longer one becomes the table of what it makes of each state.
LISTED = 256
#: Events after which most states have met: the rest of a run is folded from the few states that are left.
HEAD = 64
#: Pairs of an owner's topics and texts that are tested one by one, for each million texts and at least; beyond it an index finds those that match.
PRODUCT = 50_000_000
#: Rows that are made of topics and what bears on them before both are dealt out by owner and topic, over so many partitions at most; equal topics
#: of an owner that make more are dealt into slices.
PAIRS, MOST_PARTITIONS = 1 << 23, 2_000
KEY = ["owner_id", "ckey", "a", "b"]


def transition(state: int, direction: int) -> int:
    """State after a correction; 0 is none, else 1 + 101 * direction + hundredths."""
    if state == 0:
        return 1 + 101 * direction + FIRST
    held, c = divmod(state - 1, 101)
    c /= 100
    if held == direction:
        return 1 + 101 * held + round(round(c + (1 - c) * REINFORCE, 2) * 100)
    c = round(c * (1 - CONTRADICT), 2)
    return 1 + 101 * direction + TURNED if c < FLIP_BELOW else 1 + 101 * held + round(c * 100)


STATES = 203
TABLE = [transition(s, d) for d in (0, 1) for s in range(STATES)]


def keyed(events: DataFrame) -> DataFrame:
    """Events with their key, direction and, for declarations, hundredths."""
    high, low = F.lower("higher"), F.lower("lower")
    # Half-way cases of a typed confidence are its double's, so the rounding is of the double's digits.
    held = F.bround(F.when(F.col("confidence").isNotNull(), F.greatest(F.least(F.col("confidence"), F.lit(0.99)), F.lit(0.05))).cast("decimal(20,17)"), 2)
    return events.select(
        "owner_id", "seq", "context", "higher", "lower", F.lower("context").alias("ckey"), F.least(high, low).alias("a"), F.greatest(high, low).alias("b"),
        (high > low).cast("int").alias("dir"), (held * 100).cast("int").alias("conf"),
    )


def _start(state: Column) -> Column:
    return F.struct(state.alias("state"), F.lit(0).alias("evidence"), F.lit(None).cast("struct<higher:string,lower:string>").alias("names"))


def _step(acc: Column, e: Column) -> Column:
    state = F.when(e["conf"].isNotNull(), e["dir"] * 101 + e["conf"] + 1).otherwise(F.element_at(F.array(*map(F.lit, TABLE)), e["dir"] * STATES + acc["state"] + 1))
    side = lambda s: F.floor((s - 1) / 101)
    named = e["conf"].isNotNull() | (acc["state"] == 0) | (side(state) != side(acc["state"]))
    count = F.when(acc["state"] == 0, 1).otherwise(acc["evidence"] + e["conf"].isNull().cast("int"))
    return F.struct(state.alias("state"), count.alias("evidence"), F.when(named, F.struct(e["higher"], e["lower"])).otherwise(acc["names"]).alias("names"))


def _then(acc: Column, to: Column) -> Column:
    """The state after acc and what follows it; that was counted from nothing, so evidence adds up."""
    return F.struct(to["state"].alias("state"), (acc["evidence"] + to["evidence"]).alias("evidence"), F.coalesce(to["names"], acc["names"]).alias("names"))


def _over(acc: Column, run: Column) -> Column:
    """The state after a whole run: step by step, or as its table says."""
    return F.when(run["table"].isNull(), F.aggregate(run["events"], acc, _step)).otherwise(_then(acc, F.element_at(run["table"], acc["state"] + 1)))


def _run(first: Column, n: Column, events: Column, table: Column, listed: int) -> Column:
    """A run: its first event's seq and context, its size, and its events or, where these are many, the table of what it makes of each state."""
    few = n <= listed
    return F.struct(first["seq"].alias("seq"), first["context"].alias("context"), n.alias("n"), F.when(few, events).alias("events"), F.when(~few, table).alias("table"))


def _from_each(x: Column):
    """outcome(start) of a long list of events: its head from every state, the rest once for each state that the head leaves."""
    listed = F.sequence(F.lit(0), F.lit(STATES - 1))
    head, tail = F.slice(x, 1, HEAD), F.slice(x, HEAD + 1, F.greatest(F.size(x) - HEAD, F.lit(0)))

    def whole(heads: Column) -> Column:
        left = F.array_distinct(F.transform(heads, lambda h: h["state"]))
        # A lambda's variable is worked out once.
        return F.get(F.transform(F.array(F.struct(left.alias("left"), F.transform(left, lambda s: F.aggregate(tail, _start(s), _step)).alias("to"))), lambda t: F.transform(heads, lambda h: _then(h, F.element_at(t["to"], F.array_position(t["left"], h["state"]).cast("int"))))), F.lit(0))

    return F.get(F.transform(F.array(F.transform(listed, lambda s: F.aggregate(head, _start(s), _step))), whole), F.lit(0))


def event_runs(marked: DataFrame, bits: int = RUN_BITS[0], listed: int = LISTED) -> DataFrame:
    """KEY, place, run of `keyed` events: one run for each stretch of 2^bits seqs, so of that many events at most."""
    own = F.array_sort(F.collect_list(F.struct("seq", "dir", "conf", "higher", "lower", "context")))
    rows = marked.withColumn("seq", F.col("seq").cast("long")).groupBy(*KEY, F.shiftright("seq", bits).alias("place")).agg(own.alias("own"))
    x = F.col("own")
    return rows.select(*KEY, "place", _run(x[0], F.size(x), x, _from_each(x), listed).alias("run"))


def joined_runs(runs: DataFrame, bits: int, listed: int = LISTED) -> DataFrame:
    """The same with 2^bits places together: runs in order make one run."""
    rows = runs.groupBy(*KEY, F.shiftright("place", bits).alias("place")).agg(F.array_sort(F.collect_list("run")).alias("own"))
    x = F.col("own")
    n = F.aggregate(x, F.lit(0), lambda a, r: F.least(a + r["n"], F.lit(1 << 30)))
    table = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.aggregate(x, _start(s), _over))
    return rows.select(*KEY, "place", _run(x[0], n, F.flatten(F.transform(x, lambda r: r["events"])), table, listed).alias("run"))


def batch_runs(events: DataFrame, bits: int = RUN_BITS[0], listed: int = LISTED) -> DataFrame:
    """KEY, place, run of events: one run a key, or two where seqs of either sign meet."""
    runs = event_runs(keyed(events), bits, listed)
    return joined_runs(joined_runs(runs, RUN_BITS[1] - RUN_BITS[0], listed), 63, listed)


#: What is held of a key.
HELD = "struct<seq:bigint,context:string,state:int,evidence:int,names:struct<higher:string,lower:string>>"


def resumed(held: DataFrame, runs: DataFrame) -> DataFrame:
    """KEY, version, held of states `held` (the same) and the runs (KEY, version, place, run) that follow them.

    Runs go by version, then place; a key's version is the last that it has. One shuffle, by key; equal null keys are one key.
    """
    kind = dict(runs.dtypes)["run"]
    rows = held.select(*KEY, "version", F.lit(0).cast("long").alias("place"), F.lit(None).cast(kind).alias("run"), "held")
    rows = rows.unionByName(runs.select(*KEY, "version", "place", "run", F.lit(None).cast(dict(held.dtypes)["held"]).alias("held")))
    order = F.when(F.col("run").isNotNull(), F.struct("version", "place", "run"))
    own = rows.groupBy(*KEY).agg(F.max("version").alias("version"), F.first("held", ignorenulls=True).alias("held"), F.array_sort(F.collect_list(order)).alias("own"))
    old, first = F.col("held"), F.col("own")[0]["run"]
    begin = F.when(old.isNull(), _start(F.lit(0))).otherwise(F.struct(old["state"].alias("state"), old["evidence"].alias("evidence"), old["names"].alias("names")))
    done = own.withColumn("s", F.aggregate("own", begin, lambda acc, r: _over(acc, r["run"])))
    of = lambda c: F.when(old.isNull(), first[c]).otherwise(old[c]).alias(c)
    return done.select(*KEY, "version", F.struct(of("seq"), of("context"), *(F.col("s")[c].alias(c) for c in ("state", "evidence", "names"))).cast(HELD).alias("held"))


def as_priorities(states: DataFrame) -> DataFrame:
    """owner_id, seq, context, higher, lower, confidence, evidence of states (owner_id, seq, context, higher, lower, state, evidence)."""
    hundredths = F.pmod(F.col("state") - 1, F.lit(101))
    return states.select("owner_id", "seq", "context", "higher", "lower", (hundredths.cast("decimal(5,0)") / 100).cast("decimal(3,2)").alias("confidence"), "evidence")


def folded_runs(runs: DataFrame) -> DataFrame:
    """owner_id, seq, context, higher, lower, state, evidence of all runs of each key."""
    done = runs.groupBy(*KEY).agg(F.array_sort(F.collect_list("run")).alias("own"))
    named = done.select("owner_id", F.col("own")[0].alias("first"), F.aggregate("own", _start(F.lit(0)), _over).alias("s"))
    return named.select("owner_id", "first.seq", "first.context", "s.names.higher", "s.names.lower", "s.state", "s.evidence")


def fold_priorities(events: DataFrame, bits: tuple[int, ...] = RUN_BITS, listed: int = LISTED) -> DataFrame:
    """owner_id, seq, context, higher, lower, confidence, evidence: the current priorities.

    seq and context are those of the key's first event; higher and lower are written as by the event that
    set their direction. An owner's list is ordered by confidence, largest first, then seq. A key's events are folded by
    runs of 2^bits[0] seqs, these by runs of 2^bits[1] and so on, as far as the log's seqs reach: as seqs are unique, no list is longer.
    """
    ends = events.agg(F.min("seq"), F.max("seq")).first()
    reach = max((abs(int(e)) for e in ends if e is not None), default=0)
    runs = event_runs(keyed(events), bits[0], listed)
    for before, now in zip(bits, bits[1:]):
        if reach >> now:
            runs = joined_runs(runs, now - before, listed)
    return as_priorities(folded_runs(runs))


def find_priority(priorities: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (owner_id, context, a, b and more) with the first priority of the same context and unordered pair."""
    pair = [F.least(F.lower("higher"), F.lower("lower")).alias("k1"), F.greatest(F.lower("higher"), F.lower("lower")).alias("k2")]
    first = priorities.groupBy("owner_id", F.lower("context").alias("kc"), *pair).agg(F.min_by(F.struct("seq", "higher", "lower", "confidence"), "seq").alias("found"))
    asked = wanted.withColumns({"kc": F.lower("context"), "k1": F.least(F.lower("a"), F.lower("b")), "k2": F.greatest(F.lower("a"), F.lower("b"))})
    return asked.join(first, ["owner_id", "kc", "k1", "k2"], "left").drop("kc", "k1", "k2")


def ranked(priorities: DataFrame) -> DataFrame:
    """With `place` within the owner: confidence descending, ties in stored order."""
    return priorities.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("confidence"), "seq")))


def priorities_for(priorities: DataFrame, context: str | None) -> DataFrame:
    """Those whose context contains the given one or is generic; all without one; ranked."""
    kept = priorities.where(holds(F.col("context"), context) | generic(F.col("context"))) if context else priorities
    return ranked(kept)


def topical(topic: Column, context: Column) -> Column:
    return holds(context, topic) | holds(topic, context) | generic(context)


TOPIC = ["owner_id", "topic_id"]


def _matches(topics: DataFrame, texts: DataFrame, column: str, both: bool) -> DataFrame:
    """owner_id, asked, and the owner's texts that bear on it: texts that hold it, and with `both` texts in it and generic ones.

    Distinct pairs are tested one by one while there are few of them in all; beyond PRODUCT they come from an index of
    grams, so an owner of very many texts and topics costs what it finds.
    """
    asked, held = topics.select("owner_id", "asked").distinct(), texts.select("owner_id", column).distinct()
    counts = asked.groupBy("owner_id").count().join(held.groupBy("owner_id").agg(F.count("*").alias("n")), "owner_id")
    pairs, texts = counts.agg(F.sum(F.col("count").cast("double") * F.col("n")), F.sum("n")).first()
    if (pairs or 0) <= PRODUCT * max(1, (texts or 0) / 1_000_000):
        return asked.join(held, "owner_id").where(topical(F.col("asked"), F.col(column)) if both else holds(F.col(column), F.col("asked")))
    topic, text = asked.withColumnRenamed("asked", "needle"), held.withColumnRenamed(column, "text")
    found = containing(topic, text).select("owner_id", F.col("needle").alias("asked"), F.col("text").alias(column))
    if both:
        turned = containing(text.withColumnRenamed("text", "needle"), topic.withColumnRenamed("needle", "text"))
        found = found.unionByName(turned.select("owner_id", F.col("text").alias("asked"), F.col("needle").alias(column)))
        found = found.unionByName(asked.join(held.where(generic(F.col(column))), "owner_id").select("owner_id", "asked", column)).distinct()
    return found


def _asked(topics: DataFrame) -> DataFrame:
    return topics.withColumn("asked", F.coalesce("topic", F.lit("")))


def _bearing(asked: DataFrame, rows: DataFrame, column: str, both: bool) -> DataFrame:
    """rows with `asked`, for each distinct topic of the owner that they bear on."""
    return _matches(asked, rows, column, both).join(rows, ["owner_id", column])


def _paired(topics: DataFrame, held: DataFrame, pairs: int, by: tuple[str, ...] = ("owner_id", "asked"), weight: Column | None = None) -> DataFrame:
    """topics joined with held by owner and asked, or `by`, after which nothing is shuffled.

    Over `pairs` rows both are dealt out by these; equal topics that make more than that are cut into slices, each with a copy of what is held.
    `weight` is how many rows one of held counts as.
    """
    held = settled(held)
    counts = topics.groupBy(*by).agg(F.count("*").alias("n")).join(held.groupBy(*by).agg((F.count("*") if weight is None else F.sum(weight)).alias("m")), [*by])
    made = F.col("n").cast("double") * F.col("m")
    sliced = settled(counts.select(*by, made.alias("made"), F.greatest(F.lit(1), F.least("n", F.ceil(made / pairs))).cast("int").alias("slices")))
    every, total = sliced.agg(F.sum("made"), F.sum("slices")).first()
    if (every or 0) <= pairs:
        if weight is None:
            return topics.join(held, [*by])
        alike = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in by))
        return topics.join(held.withColumnsRenamed({c: f"_of{c}" for c in by}), alike).drop(*(f"_of{c}" for c in by))
    # A given number of partitions is kept: by their sizes in bytes, which tell nothing of the rows made, they would be put together to few.
    parts, slices = min(MOST_PARTITIONS, total), small(sliced.select(*by, "slices"))
    dealt = topics.join(slices, [*by]).withColumn("slice", F.pmod(F.xxhash64("topic_id"), F.col("slices")).cast("int")).drop("slices").repartition(parts, *by, "slice")
    copied = held.join(slices, [*by]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").repartition(parts, *by, "slice")
    # Merged, so that a broadcast doesn't undo the slices: lists are many times as large as the files that they are read from.
    return dealt.join(copied.hint("merge"), [*by, "slice"]).drop("slice")


def _weight(c: str, kind: str) -> Column:
    """How many rows a value counts as: one for each entry of a list or 16 bytes of a string."""
    return F.size(c) if kind.startswith("array") else F.octet_length(c) / 16 if kind == "string" else F.lit(0)


def basis_priorities(topics: DataFrame, priorities: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """topics (owner_id, topic_id, topic) with each priority of the owner that bears on it, ranked by `place`.

    A topic is known by owner and id; contexts are compared within owners only. Topics without any stay out.
    """
    every = _asked(topics)
    joined = _paired(every, _bearing(every, settled(priorities), "context", True), pairs).drop("asked")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(*TOPIC).orderBy(F.desc("confidence"), "seq")))


def basis_facts(topics: DataFrame, facts: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """topics with each fact of the owner that contains it, in stored order."""
    every = _asked(topics)
    return _paired(every, _bearing(every, facts, "fact", False), pairs).drop("asked")


def explain_basis(topics: DataFrame, priorities: DataFrame, facts: DataFrame, shown: dict[str, Column] | None = None, pairs: int = PAIRS) -> DataFrame:
    """Each topic with its priorities (ranked) and facts (in order) as arrays, empty where none bears on it.

    What bears on a topic is listed once for each distinct one of an owner; topics meet the lists last, so no list is shuffled
    for each topic. `shown` names what is made of the arrays instead of them, once for each list. Rows of one id are one topic.
    Where topics and lists make over `pairs` entries together, a task makes that many of a topic at most: writers look at how much they hold after so many
    rows, and a run of short rows before long ones lets them hold all of the long ones.
    """
    asks = F.when(F.col("topic_id").isNotNull(), F.array_sort(F.collect_list(F.coalesce("topic", F.lit(""))).over(Window.partitionBy(*TOPIC))))
    # Nulls in a struct are alike.
    every = settled(topics.withColumn("_asks", F.struct("owner_id", asks.alias("asks"))))
    lists = settled(every.select("owner_id", "_asks").distinct())
    each = lists.withColumn("asked", F.explode("_asks.asks"))
    near = each.join(_bearing(each, settled(priorities), "context", True), ["owner_id", "asked"])
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("_asks").orderBy(F.desc("confidence"), "seq")))
    p = near.groupBy("_asks").agg(F.array_sort(F.collect_list(F.struct("place", "context", "higher", "lower", "confidence"))).alias("priorities"))
    f = each.join(_bearing(each, facts, "fact", False), ["owner_id", "asked"]).groupBy("_asks").agg(F.array_sort(F.collect_list(F.struct("seq", "fact"))).alias("facts"))
    joined = lists.select("_asks").join(p, "_asks", "left").join(f, "_asks", "left")
    kind = dict(joined.dtypes)
    none = lambda c: F.coalesce(c, F.array().cast(kind[c])).alias(c)
    basis = joined.select("_asks", none("priorities"), none("facts"))
    if shown:
        basis = basis.select("_asks", *(c.alias(name) for name, c in shown.items()))
    # The lists are settled before the join, so that what is made of them is made once and not for each topic.
    weight = sum((_weight(c, k) for c, k in basis.dtypes if c != "_asks"), F.lit(1))
    return _paired(every, basis, pairs, ("_asks",), weight).select(*topics.columns, *(shown or ("priorities", "facts")))
