"""Mixing sources to target weights.

Words are summed per source, targets are shared out by weight with what exceeds a source's limit
reshared, and each document gets floor(rate) copies plus one more with probability frac(rate),
drawn from a hash of its id, so reruns agree.

Defined results: null text has size 0; a null source is a source of its own and comes last; a
source of size 0 has target 0, so its documents leave the mix; equal ids draw alike, so repeated rows are
taken alike; a very long text is taken whole or not at all, as any other; an empty table gives an empty
result; other columns, whatever their names, are ignored by `source_mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import WORD, settled, spread

#: Sources up to this many may be broadcast (counted first); beyond it the join shuffles.
BROADCAST_SOURCES = 10_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id, seed: str):
    """A number in [0, 1) from the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """source, source_size, target for sizes (source, size); weights repeat over the sources in code point order."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.asc_nulls_last("source")
    ranked = settled(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # The id holds partition and place in it; a row per partition gives the rank.
    counts = dict(ranked.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    starts = sizes.sparkSession.createDataFrame(offsets, "p long, before long")
    ranked = ranked.withColumn("p", part).join(F.broadcast(starts), "p")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before") + within, F.lit(len(weights))) + 1).cast("int"))
    ranked = settled(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("limit")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("limit") < F.lit(level) * F.col("weight")
        n, used, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total * percent / 100 - (used or 0)) / free
    share = F.lit(level or 0.0) * F.col("weight")
    return ranked.select("source", "source_size", F.least(share, F.col("limit").cast("double")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """docs, which have source, doc_id and size, with source_size, target and copies added."""
    targets = settled(source_targets(docs.select("source", "size"), weights, percent, most)).withColumnRenamed("source", "of_source")
    few = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + extra)


def source_mix(docs: DataFrame) -> DataFrame:
    sizes = settled(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_plan(sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the columns stay."""
    names = docs.columns
    packed = spread(docs).select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*names).alias("row"))
    taken = mix_plan(packed).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
t AS (SELECT sum(source_size)::BIGINT AS total FROM s),
l(step, level) AS (
  SELECT 0, (SELECT total * 150 / 100 FROM t) / (SELECT sum(weight) FROM s)
  UNION ALL
  SELECT step + 1, ((SELECT total * 150 / 100 FROM t) - (SELECT coalesce(sum(2 * source_size), 0)::BIGINT FROM s WHERE 2 * source_size < level * weight)) / (SELECT sum(weight) FROM s WHERE NOT 2 * source_size < level * weight)
  FROM l WHERE step < 60),
g AS (SELECT s.*, least(level * weight, 2 * source_size)::DOUBLE AS target FROM s, (SELECT max_by(level, step) AS level FROM l)),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0 ELSE g.target / g.source_size END AS rate, ('0x' || md5('mix/' || coalesce(d.doc_id::VARCHAR, ''))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
"""
