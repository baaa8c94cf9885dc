"""Opportunities: a score from four questions, what it earns, and what is pending.

Scores are decimals rounded half up; the double arithmetic of a scalar implementation can differ at exact ties only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import blank, holds, stripped
from millrace.operators.ordered import LIMITED, placed

# The score's parts and the bars.
BASE, ALIGNED, GOAL, RISK, URGENT = "0.20", "0.25", "0.20", "0.15", "0.20"
INTERRUPT, BRIEF = "0.75", "0.40"


def _d(x: str):
    return F.lit(x).cast("decimal(3,2)")


def score_opportunities(entries: DataFrame) -> DataFrame:
    """entries (what, aligns_with, advances_goal, reduces_risk, urgency and more) with score and status."""
    urgency = F.greatest(F.least(F.coalesce("urgency", F.lit(0.5)), F.lit(1.0)), F.lit(0.0))
    part = lambda cond, x: F.when(cond, _d(x)).otherwise(_d("0.00"))
    total = _d(BASE) + part(~blank(F.col("aligns_with")), ALIGNED) + part(~blank(F.col("advances_goal")), GOAL) + part(F.coalesce("reduces_risk", F.lit(False)), RISK)
    score = F.round(total + _d(URGENT) * urgency.cast("decimal(12,10)"), 2).cast("decimal(3,2)")
    status = F.when(F.col("score") >= _d(INTERRUPT), "interrupt").when(F.col("score") >= _d(BRIEF), "brief").otherwise("hold")
    scored = entries.withColumns({"what": stripped(F.col("what")), "urgency": urgency, "score": score, "resolved": F.lit(False), "outcome": F.lit(None).cast("string")})
    return scored.withColumn("status", status)


def resolve(opportunities: DataFrame, needle: str, outcome: str = "done", allow_empty: bool = False) -> DataFrame:
    """Unresolved ones with the needle resolved."""
    if not needle and not allow_empty:
        raise ValueError("an empty needle matches every row")
    hit = ~F.col("resolved") & holds(F.col("what"), needle)
    return opportunities.withColumn("hit", hit).withColumns({"outcome": F.when(F.col("hit"), F.lit(outcome)).otherwise(F.col("outcome")), "resolved": F.col("resolved") | F.col("hit")}).drop("hit")


def resolve_count(needle: str) -> Column:
    """Aggregate over opportunities: how many of them `resolve` resolves."""
    return F.count_if(~F.col("resolved") & holds(F.col("what"), needle))


def resolve_many(opportunities: DataFrame, needles: list[tuple[str, str]]) -> DataFrame:
    """One after the other: the first needle (needle, outcome) that a row holds resolves it."""
    for needle, outcome in needles:
        opportunities = resolve(opportunities, needle, outcome)
    return opportunities


def pending(opportunities: DataFrame, limit: int | None = None) -> DataFrame:
    """Unresolved ones by score, largest first, ties in stored order; the first `limit` of each owner."""
    left = opportunities.where("not resolved")
    if limit and limit <= LIMITED:
        return left.withColumn("place", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("score"), "seq"))).where(F.col("place") <= limit)
    rows = placed(left, ["owner_id"], "seq", lead="score")
    return rows.where(F.col("place") <= limit) if limit else rows
