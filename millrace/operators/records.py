"""Facts, goals, observations and actions: appends, anti-filters, conditional updates, last ones.

A needle is looked for with letters in either case. An empty needle is in every text; operators that
change rows refuse one unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import category, holds, stripped
from millrace.operators.ordered import LIMITED, placed


def _checked(needle: str, allow_empty: bool) -> str:
    if not needle and not allow_empty:
        raise ValueError("an empty needle matches every row")
    return needle


def remember_facts(entries: DataFrame) -> DataFrame:
    """entries (owner_id, seq, fact, category) as stored: trimmed, category `general` by default."""
    return entries.withColumns({"fact": stripped(F.col("fact")), "category": F.coalesce("category", F.lit("general"))})


def remember_once(entries: DataFrame) -> DataFrame:
    """The first entry of each owner's exact fact, by seq."""
    first = Window.partitionBy("owner_id", "fact").orderBy("seq")
    return entries.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def forget(facts: DataFrame, needle: str, allow_empty: bool = False) -> DataFrame:
    """Facts without the needle."""
    return facts.where(~holds(F.col("fact"), _checked(needle, allow_empty)))


def forget_count(needle: str) -> Column:
    """Aggregate over facts: how many of them `forget` removes."""
    return F.count_if(holds(F.col("fact"), needle))


def add_goals(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"goal": stripped(F.col("goal")), "active": F.lit(True)})


def close_goals(goals: DataFrame, needle: str, allow_empty: bool = False) -> DataFrame:
    """Goals, active ones with the needle closed; `closed` tells which."""
    hit = F.col("active") & holds(F.col("goal"), _checked(needle, allow_empty))
    return goals.withColumn("closed", hit).withColumn("active", F.col("active") & ~F.col("closed"))


def close_count(needle: str) -> Column:
    """Aggregate over goals: how many of them `close_goals` closes."""
    return F.count_if(F.col("active") & holds(F.col("goal"), needle))


def active_goals(goals: DataFrame) -> DataFrame:
    return goals.where("active")


def log_observations(entries: DataFrame) -> DataFrame:
    """Notes trimmed; categories stay as given, `general` by default."""
    return entries.withColumns({"note": stripped(F.col("note")), "category": F.coalesce("category", F.lit("general"))})


def log_actions(entries: DataFrame) -> DataFrame:
    """Categories trimmed and in lower case."""
    return entries.withColumn("category", category(F.col("category")))


def newest(log: DataFrame, limit: int) -> DataFrame:
    """An owner's last `limit` rows, newest first by position; 0 is all, a negative number drops that many oldest."""
    if 0 < limit <= LIMITED:
        return log.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("seq")))).where(F.col("place") <= limit)
    if limit >= 0:
        rows = placed(log, ["owner_id"], "seq", newest=True)
        return rows.where(F.col("place") <= limit) if limit else rows
    return placed(log, ["owner_id"], "seq", newest=True, total="_rows").where(F.col("place") <= F.col("_rows") + limit).drop("_rows")
