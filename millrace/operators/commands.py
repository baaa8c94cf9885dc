"""Forget, close and resolve as commands in an owner's log: each changes only what stands before it.

Commands: owner_id, seq, kind (`forget`, `close`, `resolve`), needle, outcome (of a resolve; `done` by default). They share an
owner's seq with the rows. A row is changed by the first command after it whose needle its text holds, letters in
either case; later commands don't see it any more, and rows added later aren't touched. Replayed one by one, the
commands leave the same.

An owner of up to FEW different needles has its commands in stretches of STRETCH: each stretch lists its own commands and, of
each needle, the first one after it. A row is looked up by its place among the ends of stretches and takes the first of its stretch's list that
is after it and whose needle it holds: rows are neither sorted nor multiplied. For other owners, which needles a text holds comes
from an index (`containing`), when the next command with a needle comes from an as-of join by needle. An owner's rows and commands are never multiplied.

Defined results: a command with a null or empty needle is refused, changes nothing and counts 0 (`allow_empty`: an empty one
changes all before it); a command or row without owner or seq changes nothing and is not changed; a null text holds
nothing; of commands at one place the smallest by outcome counts, and a row at a command's own place is not before it;
repeated rows are changed together; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import HOT_ROWS, as_of, containing, placed
from millrace.sources.shared import settled, small

# The kinds of commands, and the outcome of a resolve that names none.
FORGET, CLOSE, RESOLVE, DONE = "forget", "close", "resolve", "done"
#: Different needles of an owner up to which its commands are listed by stretches, and how many commands a stretch has.
FEW, STRETCH = 32, 16
#: Bytes of lists up to which they are broadcast, those that an entry takes besides its texts, and the numbers that deal out rows without a list.
BROADCAST_LISTS, ENTRY_BYTES, APART = 1 << 28, 56, 1 << 12


def refused(commands: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Commands that change nothing, for want of a needle."""
    return commands.where("needle IS NULL" if allow_empty else "coalesce(needle, '') = ''")


def _reached(ends: Column, at: Column, most: int) -> Column:
    """How many numbers of a sorted array of `most` at most are not above `at`, by halving."""
    powers = F.array(*(F.lit(1 << k) for k in reversed(range(max(most, 1).bit_length()))))
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when(F.get(ends, n + p - 1) <= at, n + p).otherwise(n))


def _by_stretches(rows: DataFrame, due: DataFrame, text: str, hot: int) -> DataFrame:
    """rows with `hit` by commands (owner_id, seq, needle, outcome) of owners that have few needles."""
    command, by = F.struct("seq", "outcome", F.lower("needle").alias("needle")).alias("command"), ["owner_id", "_stretch"]
    due = settled(placed(due, ["owner_id"], "seq", hot=hot).select("owner_id", F.floor((F.col("place") - 1) / STRETCH).cast("int").alias("_stretch"), command))
    ends = due.groupBy(*by).agg(F.max("command.seq").alias("end"))
    # The first command of each needle after a stretch, for all needles of its owner.
    firsts = due.groupBy(*by, "command.needle").agg(F.min("command").alias("first"))
    later = Window.partitionBy("owner_id", "needle").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    grid = ends.select(*by).join(due.select("owner_id", "command.needle").distinct(), "owner_id").join(firsts, [*by, "needle"], "left")
    after = grid.withColumn("command", F.last("first", ignorenulls=True).over(later)).where("command IS NOT NULL").select(*by, "command")
    lists = settled(due.unionByName(after).groupBy(*by).agg(F.array_sort(F.collect_list("command")).alias("_list")))
    weight = F.aggregate("_list", F.lit(0).cast("long"), lambda n, c: n + ENTRY_BYTES + F.octet_length(c["needle"]) + F.octet_length(c["outcome"]))
    size, last = lists.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max("_stretch"), F.lit(-1))).first()
    lists = F.broadcast(lists) if size <= BROADCAST_LISTS else lists
    # A stretch that ends where the one before does adds nothing to look up, so ends may repeat.
    own_ends = settled(ends.groupBy("owner_id").agg(F.array_sort(F.collect_list("end")).alias("_ends")))
    asked = rows.join(small(own_ends), "owner_id", "left").withColumns({"_at": _reached(F.col("_ends"), F.col("seq"), last + 1), "_low": F.lower(text)})
    # Rows that no list is for get one of APART numbers below zero: a shuffle deals them out, however many an owner has.
    apart = -1 - F.pmod(F.xxhash64("seq", "_low"), F.lit(APART)).cast("int")
    asked = asked.withColumn("_stretch", F.when((F.col("_at") < F.size("_ends")) & F.col("seq").isNotNull(), F.col("_at")).otherwise(apart)).drop("_ends", "_at")
    met = F.filter("_list", lambda c: (c["seq"] > F.col("seq")) & F.contains(F.col("_low"), c["needle"]))
    # One expression, so that a list is gone through once.
    hit = F.get(F.transform(F.slice(met, 1, 1), lambda c: F.struct(c["seq"].alias("seq"), c["outcome"].alias("outcome"))), F.lit(0))
    return asked.join(lists, by, "left").select(*rows.columns, hit.alias("hit"))


def _by_needles(rows: DataFrame, due: DataFrame, text: str, hot: int) -> DataFrame:
    """rows with `hit`, by the index and an as-of join by needle."""
    short = rows.select("owner_id", "seq", F.col(text).alias("text")).where("owner_id IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL").distinct()
    met = settled(short.join(containing(due, short), ["owner_id", "text"]))
    # Of one needle's commands at one place the smallest counts.
    once = due.groupBy("owner_id", "needle", "seq").agg(F.struct("seq", F.min("outcome").alias("outcome")).alias("command"))
    next_one = as_of(met, once, ["owner_id", "needle"], "seq", ["command"], strict=True, forward=True, hot=hot)
    hits = next_one.where("found IS NOT NULL").groupBy("owner_id", "seq", "text").agg(F.min("found.command").alias("hit")).withColumnRenamed("text", text)
    return rows.join(hits, ["owner_id", "seq", text], "left").select(*rows.columns, "hit")


def with_hits(rows: DataFrame, commands: DataFrame, text: str, allow_empty: bool = False, hot: int = HOT_ROWS, few: int = FEW) -> DataFrame:
    """rows (owner_id, seq, text and more) with `hit`: (seq, outcome) of the first command after it that its text meets, or null."""
    due = commands.where("needle IS NOT NULL" if allow_empty else "needle <> ''").where("owner_id IS NOT NULL AND seq IS NOT NULL")
    due = due.select("owner_id", "seq", "needle", F.coalesce("outcome", F.lit(DONE)).alias("outcome"))
    many = settled(due.select("owner_id", F.lower("needle").alias("needle")).distinct().groupBy("owner_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("owner_id"))
    if many.isEmpty():
        return _by_stretches(rows, due, text, hot)
    of = lambda df, how: df.join(small(many), "owner_id", how)
    return _by_stretches(of(rows, "left_anti"), of(due, "left_anti"), text, hot).unionByName(_by_needles(of(rows, "left_semi"), of(due, "left_semi"), text, hot))


def _of(commands: DataFrame, kind: str) -> DataFrame:
    return commands.where(F.col("kind") == kind)


def facts_after(facts: DataFrame, commands: DataFrame, **how) -> DataFrame:
    """Facts that no forget removed."""
    return with_hits(facts, _of(commands, FORGET), "fact", **how).where("hit IS NULL").drop("hit")


def goals_after(goals: DataFrame, commands: DataFrame, **how) -> DataFrame:
    """Goals with `active` as it is in the end and `closed_by`, the seq of the command that closed it; others were closed before."""
    open_ones = with_hits(goals.where("active"), _of(commands, CLOSE), "goal", **how)
    changed = open_ones.withColumns({"active": F.col("hit").isNull(), "closed_by": F.col("hit.seq")}).drop("hit")
    return changed.unionByName(goals.where("NOT coalesce(active, false)").withColumn("closed_by", F.lit(None).cast(changed.schema["closed_by"].dataType)))


def opportunities_after(opportunities: DataFrame, commands: DataFrame, **how) -> DataFrame:
    """Opportunities with `resolved` and `outcome` as they are in the end and `resolved_by`."""
    open_ones = with_hits(opportunities.where("NOT resolved"), _of(commands, RESOLVE), "what", **how)
    changed = open_ones.withColumns({"resolved": F.col("hit").isNotNull(), "outcome": F.coalesce("hit.outcome", "outcome"), "resolved_by": F.col("hit.seq")}).drop("hit")
    return changed.unionByName(opportunities.where("coalesce(resolved, true)").withColumn("resolved_by", F.lit(None).cast(changed.schema["resolved_by"].dataType)))


def command_counts(commands: DataFrame, facts: DataFrame, goals: DataFrame, opportunities: DataFrame, **how) -> DataFrame:
    """commands with `changed`, how many rows each of them changed."""
    none = F.lit(0).cast("long")
    parts = ((FORGET, facts, "fact"), (CLOSE, goals.where("active"), "goal"), (RESOLVE, opportunities.where("NOT resolved"), "what"))
    hit = None
    for kind, rows, text in parts:
        own = with_hits(rows, _of(commands, kind), text, **how).where("hit IS NOT NULL").groupBy("owner_id", F.col("hit.seq").alias("seq")).agg(F.count("*").alias("changed")).withColumn("kind", F.lit(kind))
        hit = own if hit is None else hit.unionByName(own)
    return commands.join(hit, ["owner_id", "seq", "kind"], "left").select(*commands.columns, F.coalesce("changed", none).alias("changed"))
