"""Helpers of this subpackage: tables on the shared folder, components, words as arrays."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import settled, spread

#: One word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
#: Up to this many ids (8 bytes each) a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Bits of the map that ids beyond that are looked up in before a shuffle (16 MB, broadcast), and of a row of it.
SIFT_BITS, SIFT_ROW = 1 << 27, 1 << 15
#: Bytes of rows that a Python task gets at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame) -> DataFrame:
    """df on all cores; from here on the session hands Python BATCH_BYTES of rows at a time, or one row if that is longer.

    A session that was given another size, smaller than that, keeps it.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    had = conf.get(key).removesuffix("b")
    if not had.isdigit() or int(had) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return spread(df)


def lean(run):
    """run over a task's batches; then the Arrow memory that its worker holds unused goes back, as the worker lives on."""

    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return held


def _maybe(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """df with `_maybe`: whether a map of fixed size has a bit for the row's `on`, as it has for all ids and few others."""
    bit = F.pmod(F.xxhash64(on), F.lit(SIFT_BITS))
    place, row = F.pmod(bit, F.lit(SIFT_ROW)), F.shiftright(bit, SIFT_ROW.bit_length() - 1).alias("_row")
    maps = settled(ids.groupBy(row).agg(F.bitmap_construct_agg(place).alias("_bits")))  # SIFT_BITS / SIFT_ROW rows at most
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(byte / F.pow(F.lit(2), F.pmod("_place", F.lit(8))), F.lit(0)).cast("int") % 2 == 1
    return df.withColumns({"_row": row, "_place": place}).join(F.broadcast(maps), "_row", "left").withColumn("_maybe", held).drop("_row", "_place", "_bits")


def sifted(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is among the ids, without a shuffle; of ids too many to be broadcast the map lets a few others through."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), on, "left_semi")
    return _maybe(df, ids, on).where("_maybe").drop("_maybe")


def keyed_join(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a table of ids: broadcast up to BROADCAST_IDS rows, counted first, else a shuffled join.

    Rows that have no id are not shuffled for an inner, semi or anti join.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    if few or how not in ("inner", "left_semi", "left_anti"):
        return df.join(F.broadcast(ids) if few else ids, on, how)
    marked = _maybe(df, ids, on)
    joined = marked.where("_maybe").drop("_maybe").join(ids, on, how)
    return joined.unionByName(marked.where("NOT _maybe").drop("_maybe")) if how == "left_anti" else joined


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as rows (node, label), label the smallest node of the component.

    Alternating large-star and small-star steps: each is a min per node and a join,
    so no neighbour list is ever gathered. Self-loops are dropped; no edges give no rows.
    """

    def mark(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(now)
    while True:
        # A step's minima, two a link at most, are broadcast where the links are few: a large star is then no task of its own.
        few = F.broadcast if before[0] <= BROADCAST_IDS // 4 else lambda df: df
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(few(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(few(low), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = settled(small.where("a <> b").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b"))).distinct()


# ---- words of many texts as arrays of 64-bit hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_CODES = {s: _byte_codes(s) for s in (11, 12)}


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 19), np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = False, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and bounds: the words of text i are [bounds[i], bounds[i + 1])."""
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    at = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = at[0::2], at[1::2]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(starts, first)
    if lower:
        buf = _LOWER[buf]
    p, inv = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[seed][buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64)), bounds


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; run i starts at word i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += words[j : j + n]
    return mix(acc)


def slices(texts: list[bytes], most: int = 250_000):
    """Ranges [i, j) of texts of about `most` bytes together."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)


def pack_cells(cells: np.ndarray) -> bytes:
    """Ordered cells as steps of 8 or 16 bits, the largest step standing for that many and no cell; or plain. The shortest counts."""
    step = np.diff(cells.astype(np.int64), prepend=0)
    best = b"\0" + cells.astype("<u4").tobytes()
    for kind, wide, size, most in ((b"\1", "<u1", 1, 255), (b"\2", "<u2", 2, 65535)):
        more = step // most
        if (len(step) + int(more.sum())) * size + 1 < len(best):
            at = np.cumsum(more + 1) - 1
            out = np.full(at[-1] + 1, most, wide)
            out[at] = step % most
            best = kind + out.tobytes()
    return best


def unpack_cells(blob: bytes) -> np.ndarray:
    if blob[0] == 0:
        return np.frombuffer(blob, "<u4", offset=1)
    wide, most = ("<u1", 255) if blob[0] == 1 else ("<u2", 65535)
    out = np.frombuffer(blob, wide, offset=1)
    return np.cumsum(out, dtype=np.int64)[out != most].astype(np.uint32)
