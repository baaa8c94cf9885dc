"""Text expressions that records are matched by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def holds(text: Column, needle: Column | str) -> Column:
    """Whether text contains the needle, letters in either case; an empty needle is in every text."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(text), F.lower(needle))


def blank(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit(""))) == ""


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def category(text: Column) -> Column:
    return F.lower(stripped(text))


#: Contexts that fit every topic.
GENERIC = ("any", "all", "general")


def generic(context: Column) -> Column:
    return F.lower(context).isin(*GENERIC)
