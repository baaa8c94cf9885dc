"""Permissions and the authorization gate: deny by default, caps by category, an audit trail.

An owner's permission for a category is the last one set; without one the level is `recommend`. A request in
the log meets the one in force at its place (`authorize_at`), one from outside the log the last of all (`authorize`).
Categories match trimmed and in lower case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import category
from millrace.operators.ordered import HOT_ROWS, as_of

# The levels, in order, and the default.
LEVELS = ("observe", "recommend", "act")
DEFAULT = "recommend"


def valid_permissions(entries: DataFrame) -> DataFrame:
    """entries (owner_id, seq, category, level, cap) of a known level, categories normalized."""
    return entries.where(F.col("level").isin(*LEVELS)).withColumn("category", category(F.col("category")))


def rejected_permissions(entries: DataFrame) -> DataFrame:
    return entries.where(~F.coalesce(F.col("level").isin(*LEVELS), F.lit(False)))


def current_permissions(entries: DataFrame) -> DataFrame:
    """The last valid level and cap of each owner and category."""
    last = F.max_by(F.struct("level", "cap", "seq"), "seq")
    return valid_permissions(entries).groupBy("owner_id", "category").agg(last.alias("p")).select("owner_id", "category", "p.level", "p.cap", "p.seq")


def permission_actions(entries: DataFrame) -> DataFrame:
    """The audit row of each valid change: what was set, to which level and cap."""
    return valid_permissions(entries).select("owner_id", "seq", "category", "level", "cap", F.lit(None).cast("double").alias("amount"), F.lit("permission_change").alias("outcome"))


def with_permission(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests with level and cap; a left join, so every request stays."""
    asked = requests.withColumn("pcat", category(F.col("category")))
    held = permissions.select("owner_id", F.col("category").alias("pcat"), "level", "cap")
    return asked.join(held, ["owner_id", "pcat"], "left").withColumn("level", F.coalesce("level", F.lit(DEFAULT)))


def authorize(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """requests (owner_id, seq, category, description, amount) with level, cap, allowed and reason.

    No level `act` is denied; then an amount over a cap; all else is allowed. A null amount passes, a
    cap of 0 is a cap.
    """
    return _decided(with_permission(requests, permissions).drop("pcat"))


def authorize_at(requests: DataFrame, entries: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The same by what was in force at each request: the last valid entry of its owner and category not after it by seq.

    requests and entries share an owner's seq; entries are as set, of any level. Later overrides change nothing before them.
    """
    held = valid_permissions(entries).withColumnRenamed("category", "pcat")
    found = as_of(requests.withColumn("pcat", category(F.col("category"))), held, ["owner_id", "pcat"], "seq", ["level", "cap"], hot=hot)
    return _decided(found.withColumns({"level": F.coalesce("found.level", F.lit(DEFAULT)), "cap": F.col("found.cap")}).drop("pcat", "found"))


def _decided(asked: DataFrame) -> DataFrame:
    over = F.coalesce(F.col("amount") > F.col("cap"), F.lit(False))
    reason = F.when(F.col("level") != "act", "level").when(over, "cap").otherwise("granted")
    return asked.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "granted")


def denials(decisions: DataFrame) -> DataFrame:
    """The audit row of each denial; what is allowed leaves none here."""
    return decisions.where("not allowed").select("owner_id", "seq", category(F.col("category")).alias("category"), "description", "amount", "level", "cap", F.concat(F.lit("denied: "), "reason").alias("outcome"))
