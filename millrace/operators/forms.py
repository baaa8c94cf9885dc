"""Profiles and forms: what can be filled from a profile, what is referred to, what is left.

Values of sensitive fields never enter a profile or a filled form; a form gets a reference to a
stored name instead, and only names are known here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.labels import field_of, field_or_slug, is_reference, sensitive, slot_for, suggested_slot
from millrace.functions.text import stripped
from millrace.operators.priorities import explain_basis
from millrace.sources.shared import settled, small


def profile_entries(entries: DataFrame) -> DataFrame:
    """entries (owner_id, seq, label, value) with field and whether they are stored."""
    named = entries.withColumn("field", field_or_slug(F.col("label")))
    return named.withColumns({"stored": ~(sensitive(F.col("label")) | sensitive(F.col("field"))), "value": stripped(F.col("value"))})


def profiles(entries: DataFrame) -> DataFrame:
    """owner_id, field, value: the last stored value of each field."""
    kept = profile_entries(entries).where("stored")
    return kept.groupBy("owner_id", "field").agg(F.max_by("value", "seq").alias("value"))


def profile_maps(fields: DataFrame) -> DataFrame:
    """owner_id and the profile as a map; an owner has few fields."""
    return fields.groupBy("owner_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("profile"))


def forget_field(maps: DataFrame, label: str) -> DataFrame:
    """Maps without the label's field; `removed` names it where it was."""
    return (
        maps.withColumn("key", field_or_slug(F.lit(label)))
        .withColumn("removed", F.when(F.map_contains_key("profile", F.col("key")), F.col("key")))
        .withColumn("profile", F.map_filter("profile", lambda k, _: k != F.col("key"))).drop("key")
    )


def full_name(profile: Column) -> Column:
    """First and last name together, where both are known and not empty."""
    first, last = profile["first_name"], profile["last_name"]
    return F.when((F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != ""), F.concat(first, F.lit(" "), last))


def label_meanings(labels: DataFrame, names: list[str], whole_words: bool = False) -> DataFrame:
    """labels (label and more) with what a label means: key, hidden (sensitive), named (the slot to suggest), held (a stored name).

    It is worked out once for each distinct label.
    """
    stored = F.array(*map(F.lit, names)).cast("array<string>")
    known = labels.select("label").distinct().withColumns({"hidden": sensitive(F.col("label")), "key": field_of(F.col("label"), whole_words), "held": slot_for(F.col("label"), stored), "named": suggested_slot(F.col("label"))})
    meant = settled(known.withColumnRenamed("label", "of_label"))
    return labels.join(small(meant), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def classify_labels(labels: DataFrame, maps: DataFrame, names: list[str], whole_words: bool = False) -> DataFrame:
    """labels (form_id, owner_id, pos, label) with the value that fills each, or why the owner has to.

    why: `sensitive` (slot tells the name to store it under) or `unknown`; null where value is given.
    """
    marked = label_meanings(labels, names, whole_words).join(maps, "owner_id", "left")
    value = F.when(F.col("hidden"), F.concat(F.lit("vault:"), "held")).otherwise(F.coalesce(F.col("profile")[F.col("key")], F.when(F.col("key") == "full_name", full_name(F.col("profile")))))
    done = marked.withColumn("value", value).withColumn("why", F.when(F.col("value").isNull(), F.when(F.col("hidden"), "sensitive").otherwise("unknown")))
    return done.withColumn("slot", F.when(F.col("why") == "sensitive", F.col("named"))).select(*labels.columns, "key", "value", "why", "slot")


def fill_forms(labels: DataFrame, maps: DataFrame, names: list[str]) -> DataFrame:
    """Per form of an owner: filled map by label (repeated labels once), labels left to the owner in order, coverage."""
    marked = classify_labels(labels, maps, names)
    # A form's labels are few; where a label repeats, its last value stands, as all are equal.
    pairs = F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.struct("label", "value"))))
    left = F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.struct("pos", "label", "why"))))
    done = marked.groupBy("owner_id", "form_id").agg(F.map_from_entries(pairs).alias("filled"), left.alias("needs_you"), F.count("*").alias("n"))
    return done.withColumn("coverage", F.concat_ws("/", F.size("filled").cast("string"), F.col("n").cast("string"))).drop("n")


def refused_values(values: DataFrame, names: list[str]) -> DataFrame:
    """values (form_id, label, value) marked `blocked` (a literal for a sensitive label) or `missing` (an unknown reference)."""
    name = F.regexp_extract(stripped(F.col("value")), "(?i)^vault:(.*)$", 1)
    ref = F.coalesce(is_reference(F.col("value")), F.lit(False))
    known = name.isin(*names) if names else F.lit(False)
    return values.withColumns({"blocked": sensitive(F.col("label")) & ~ref, "missing": ref & ~known})


def draft_guidance(topics: DataFrame, priorities: DataFrame, facts: DataFrame, maps: DataFrame, shown: dict[str, Column] | None = None) -> DataFrame:
    """topics (owner_id, topic_id, topic) with their basis (or what is `shown` of it) and the name to sign with, null if none is known."""
    p = F.col("profile")
    both = stripped(F.concat(F.coalesce(p["first_name"], F.lit("")), F.lit(" "), F.coalesce(p["last_name"], F.lit(""))))
    signer = F.coalesce(F.nullif(p["full_name"], F.lit("")), F.nullif(both, F.lit("")))
    # Signers come first: no list is shuffled once it has met its topics.
    signed = topics.join(maps.select("owner_id", signer.alias("signer")), "owner_id", "left")
    done = explain_basis(signed, priorities, facts, shown)
    return done.select(*(c for c in done.columns if c != "signer"), "signer")
