"""What the record operators rest on: the last row before another, places in an order, and texts that contain needles.

`as_of` finds, for each row, the last (or next) row of another table with the same key: one window over both,
whose keys of very many rows are cut into ranges of the order column; what is in force where a range begins is
taken from a table of one row a range. `placed` numbers a key's rows the same way. `containing` finds the pairs of an owner's needles and texts of which
the text contains the needle, by an index of short grams: a needle is looked for by its rarest gram only, and what
that finds is verified. Neither forms the product of an owner's rows.

Defined results: a null key, order value or text meets nothing; rows that tie in the order count as before
(`strict`: as not before); of several right rows at one place the largest by the taken columns counts; repeated
rows stay repeated; empty tables give no matches; columns of left may have any name but `found`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import settled, small

#: Rows of a key beyond which it is cut into ranges, and the ranges that it is cut into at most.
HOT_ROWS, MOST_RANGES = 1_000_000, 1_000
#: First rows of a key up to which each task keeps that many before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
LIMITED = 1_000
#: Characters of a gram; needles that are shorter are looked for whole.
GRAM = 3


def _parts(rows: DataFrame, by: list[str], at: str, hot: int) -> DataFrame | None:
    """rows with `part`: the range of `at` that a row of a key of more than `hot` rows lies in, else null. None without such keys."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > hot)
    most = counts.agg(F.max("n")).first()[0]
    if not most:
        return None
    ranges = min(MOST_RANGES, max(2, math.ceil(most / hot)))
    cuts = [i / ranges for i in range(1, ranges)]
    # There are no more hot keys than rows / hot.
    keys = small(settled(counts.select(*by)))
    bounds = small(settled(rows.join(keys, by).groupBy(*by).agg(F.percentile_approx(at, cuts, 10_000).alias("bounds"))))
    part = F.when(F.col("bounds").isNotNull(), F.size(F.filter("bounds", lambda b: b < F.col(at))))
    return settled(rows.join(bounds, by, "left").withColumn("part", part).drop("bounds"))


def placed(rows: DataFrame, by: list[str], at: str, lead: str | None = None, newest: bool = False, total: str | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """rows with `place`, from 1 within equal `by`: by `lead`, largest first, if given, then by `at`, a whole number (`newest`: largest first).

    A key of over `hot` rows is not sorted by one task: its rows are numbered within each value of `lead` and range of `at`,
    and begin after the rows of those before, which are counted. Nulls come last where the largest come first, else first; null
    keys are one key, which stays whole. Rows that tie come in any order. `total` names a column for the number of the key's rows.
    Columns may have any name but `place`, `total`'s and those of this function that begin with `_`.
    """
    turn = F.desc if newest else F.asc
    order = [*([F.desc("_lead")] if lead else []), turn("_at")]
    numbered = rows.withColumns({"_at": F.col(at).cast("long"), "_lead": F.col(lead) if lead else F.lit(0)})
    packed = numbered.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_at", "_lead", F.struct(*rows.columns).alias("_row"))
    keys = [f"_by{i}" for i in range(len(by))]
    cut = _parts(packed, keys, "_at", hot)
    if cut is None:
        own = Window.partitionBy(*keys)
        done = packed.withColumns({"_place": F.row_number().over(own.orderBy(*order)), **({"_total": F.count("*").over(own)} if total else {})})
    else:
        # Of other keys all rows are one group.
        groups = [*keys, "_step", "part"]
        cut = cut.withColumn("_step", F.when(F.col("part").isNotNull(), F.coalesce(F.col("_lead").cast("string"), F.lit(""))))
        counts = cut.where("part IS NOT NULL").groupBy(*groups).agg(F.count("*").alias("_n"), F.max("_lead").alias("_lead"))
        every = Window.partitionBy(*keys)
        before = every.orderBy(F.desc("_lead"), turn("part")).rowsBetween(Window.unboundedPreceding, -1)
        begins = small(settled(counts.select(*groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"), F.sum("_n").over(every).alias("_all"))))
        own = Window.partitionBy(*groups)
        done = cut.withColumns({"_place": F.row_number().over(own.orderBy(*order)), **({"_total": F.count("*").over(own)} if total else {})}).join(begins, groups, "left")
        done = done.withColumn("_place", F.col("_place") + F.coalesce("_begin", F.lit(0)))
        if total:
            done = done.withColumn("_total", F.coalesce("_all", "_total"))
    return done.select("_row.*", F.col("_place").cast("long").alias("place"), *([F.col("_total").cast("long").alias(total)] if total else []))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], strict: bool = False, forward: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """left with `found`, a struct of right's `take` columns: of the last row with equal `by` whose `at` is not after left's.

    `strict` leaves out rows at the same place; `forward` finds the next row instead of the last. `at` is a whole number.
    """
    place = F.col(at).cast("long") * (-1 if forward else 1)
    kind = right.select(F.struct(*take).alias("found")).schema["found"].dataType
    # At one place what may be found comes first, unless it mustn't.
    first, then = (1, 0) if strict else (0, 1)
    held = right.select(*by, place.alias("_at"), F.lit(first).alias("_side"), F.struct(*take).alias("_held"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    asked = left.select(*by, place.alias("_at"), F.lit(then).alias("_side"), F.lit(None).cast(kind).alias("_held"), F.struct("*").alias("_row"))
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*by, "_at"]))
    rows = held.where(known).unionByName(asked.where(known))
    cut = _parts(rows, by, "_at", hot)
    cut = cut and cut.fillna(0, "part")
    own = Window.partitionBy(*by, *(["part"] if cut else [])).orderBy("_at", "_side", "_held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = (cut or rows).withColumn("found", F.last("_held", ignorenulls=True).over(own)).where(f"_side = {then}")
    if cut:
        # What is in force where a range begins: the last of all ranges before it.
        ends = cut.groupBy(*by, "part").agg(F.max(F.when(F.col("_side") == first, F.struct("_at", "_held"))).alias("last"))
        before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        begins = ends.withColumn("begin", F.last("last", ignorenulls=True).over(before)).where("part > 0 AND begin IS NOT NULL").select(*by, "part", F.col("begin._held").alias("_begin"))
        near = near.join(small(begins), [*by, "part"], "left").withColumn("found", F.coalesce("found", "_begin"))
    free = asked.where(~known).select("_row", F.lit(None).cast(kind).alias("found"))
    return near.select("_row", "found").unionByName(free).select("_row.*", "found")


def _grams(text: Column, size: Column) -> Column:
    """The distinct grams of a size in a text, in time of its length."""

    def cut(signs: Column) -> Column:
        last = F.size(signs) - size + 1
        return F.array_distinct(F.transform(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(signs, i, size), "")))

    # A lambda's variable is worked out once.
    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), cut), F.lit(0))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (owner_id, needle, text) of needles (owner_id, needle) and texts (owner_id, text) of which the text holds the needle.

    Letters count in either case. An empty needle is in every text of its owner: these pairs are a join by owner.
    """
    wanted = needles.select("owner_id", "needle").where("owner_id IS NOT NULL AND needle IS NOT NULL").distinct()
    held = texts.select("owner_id", "text").where("owner_id IS NOT NULL AND text IS NOT NULL").distinct()
    every = wanted.where("needle = ''").join(held, "owner_id").select("owner_id", "needle", "text")
    low = F.lower("needle")
    sized = wanted.where("needle <> ''").withColumn("size", F.least(F.length(low), F.lit(GRAM)))
    asked = settled(sized.select("owner_id", "needle", "size", F.explode(_grams(low, F.col("size"))).alias("gram")))
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # GRAM numbers at most
    if not sizes:
        return every
    # A text stands in the index by a hash; that two share one costs a look, as texts are verified.
    held = held.withColumn("id", F.xxhash64("text"))
    index = held.select("owner_id", "id", F.explode(F.concat(*(_grams(F.lower("text"), F.lit(n)) for n in sizes))).alias("gram"))
    index = settled(index.join(small(asked.select("gram").distinct()), "gram", "left_semi"))
    often = index.groupBy("owner_id", "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["owner_id", "gram"], "left").groupBy("owner_id", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("pick"))
    picked = rarest.where("pick.n > 0").select("owner_id", "needle", F.col("pick.gram").alias("gram"))
    found = picked.join(index, ["owner_id", "gram"]).select("owner_id", "needle", "id").join(held, ["owner_id", "id"])
    return found.where(F.contains(F.lower("text"), low)).select("owner_id", "needle", "text").unionByName(every)
