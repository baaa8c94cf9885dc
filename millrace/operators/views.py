"""Views of an owner's records: state, brief, snapshot. `as_of` stands for the wall clock.

Each part is one aggregate per owner; parts join on the owner. Lists in a view are bounded by their
limits, or, in a snapshot, by what the owner has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.opportunities import pending
from millrace.operators.priorities import ranked
from millrace.operators.records import active_goals, newest

# How long a correction and an observation count as recent, and the lengths of a brief's lists.
CORRECTION_HOURS, OBSERVATION_HOURS = 48, 24
TOP, ACTIONS, OBSERVATIONS = 10, 10, 5


def _ts(c: str) -> Column:
    return F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0))


def owner_states(owners: DataFrame, opportunities: DataFrame, corrections: DataFrame, observations: DataFrame, as_of: Column) -> DataFrame:
    """owner_id and mood: the first that holds of protective, charged, curious, happy, thinking, calm."""
    since = lambda h: F.unix_micros(as_of.cast("timestamp")) - h * 3600 * 1_000_000
    opps = opportunities.where("not resolved").groupBy("owner_id").agg(
        F.bool_or(F.col("reduces_risk") & (F.col("status") == "interrupt")).alias("risk"), F.bool_or(F.col("status") == "interrupt").alias("interrupt"), F.bool_or(F.col("status") == "brief").alias("brief"),
    )
    learned = corrections.groupBy("owner_id").agg(F.bool_or(_ts("ts") > since(CORRECTION_HOURS)).alias("learned"))
    noticed = observations.groupBy("owner_id").agg(F.bool_or(_ts("ts") > since(OBSERVATION_HOURS)).alias("noticed"))
    every = reduce(lambda a, b: a.join(b, "owner_id", "left"), (opps, learned, noticed), owners.select("owner_id").distinct())
    mood = F.when(F.col("risk"), "protective").when(F.col("interrupt"), "charged").when(F.col("brief"), "curious").when(F.col("learned"), "happy").when(F.col("noticed"), "thinking")
    return every.select("owner_id", mood.otherwise("calm").alias("mood"))


def _listed(df: DataFrame, order: str, fields: list[str], name: str) -> DataFrame:
    """owner_id and the rows' fields as an array in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return df.groupBy("owner_id").agg(F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))


def daily_brief(owners: DataFrame, goals: DataFrame, opportunities: DataFrame, actions: DataFrame, observations: DataFrame, corrections: DataFrame, as_of: Column) -> DataFrame:
    """One row an owner: mood, goals, top opportunities, last actions and observations, corrections learned from."""
    parts = [
        _listed(active_goals(goals), "seq", ["goal"], "active_goals"),
        _listed(pending(opportunities, TOP), "place", ["what", "score", "status"], "opportunities"),
        _listed(newest(actions, ACTIONS), "place", ["category", "outcome"], "recent_actions"),
        _listed(newest(observations, OBSERVATIONS), "place", ["note"], "recent_observations"),
        corrections.groupBy("owner_id").agg(F.count("*").alias("corrections_learned_from")),
    ]
    states = owner_states(owners, opportunities, corrections, observations, as_of)
    joined = reduce(lambda a, b: a.join(b, "owner_id", "left"), parts, states)
    return joined.withColumn("corrections_learned_from", F.coalesce("corrections_learned_from", F.lit(0)))


def snapshot(owners: DataFrame, priorities: DataFrame, facts: DataFrame, goals: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row an owner: ranked priorities, facts, active goals, corrections learned from."""
    parts = [
        _listed(ranked(priorities), "place", ["context", "higher", "lower", "confidence"], "priorities"),
        _listed(facts, "seq", ["fact"], "facts"),
        _listed(active_goals(goals), "seq", ["goal"], "active_goals"),
        corrections.groupBy("owner_id").agg(F.count("*").alias("corrections_learned_from")),
    ]
    joined = reduce(lambda a, b: a.join(b, "owner_id", "left"), parts, owners.select("owner_id").distinct())
    return joined.withColumn("corrections_learned_from", F.coalesce("corrections_learned_from", F.lit(0)))
