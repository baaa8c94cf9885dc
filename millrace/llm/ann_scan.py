"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are scaled to length one and rotated at random, so any prefix of their coordinates estimates a
distance. Lists are the nearest centroids of a bounded sample; their number grows with the root of the
rows, and a list is searched in parts of LIST_ROWS vectors. Within each list that a query probes,
candidates are scanned in column blocks: after each block the likeliest are measured in full, and a
hypothesis test compares the others' partial distance, scaled up, with the query's k-th nearest so far and
gives up those that are farther with the stated confidence. What remains is ranked by the cosine of the
original vectors in double precision. How many lists are probed is measured on the sample, so that recall
there reaches the target; a query whose probed lists hold too few vectors probes further ones.

Vectors of one direction (equal to DIGITS decimals at length one) share a node and are searched once: they
are equally near to any query, and of them the smallest ids stand for all.

Defined results: vectors that are null, zero, of another length than the most common one, or that hold
null or non-finite components take no part; a query with no other vector has no rows; ties go to the
smaller vec_id; repeated ids are taken as separate vectors, but none is its own neighbour; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import settled

#: Sampled rows a list, numbers in the sample at most, lists at most (all grow with the rows up to there); rows of a list's part; queries of a task's part.
SAMPLED_EACH, SAMPLE_NUMBERS, MOST_LISTS, LIST_ROWS, QUERY_ROWS = 40, 1 << 24, 4_096, 4_096, 1_024
#: Decimals to which vectors of length one agree that count as of one direction.
DIGITS = 12
#: Columns of a block; confidence of the test in standard deviations; recall to reach on the sample.
BLOCK, SURE, RECALL = 16, 2.1, 0.97


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def list_count(rows: int) -> int:
    """The root of the rows, MOST_LISTS at most."""
    return max(1, min(math.isqrt(rows), MOST_LISTS))


def sample_rows(rows: int, width: int) -> int:
    return max(1, min(rows, SAMPLED_EACH * list_count(rows), SAMPLE_NUMBERS // width))


def _nearest_list(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])


def train(sample: np.ndarray, rows: int, k: int, rounds: int = 8, seed: int = 7) -> Index:
    """Centroids for lists of some hundred rows or more, and probes for the recall."""
    rng = np.random.default_rng(seed)
    turn = rotation(sample.shape[1])
    x = unit(sample) @ turn
    lists = max(1, min(len(x) // (SAMPLED_EACH - 1) + 1, list_count(rows)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        at = _nearest_list(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = np.linalg.norm(sums, axis=1) > 0
        c[full] = unit(sums[full])
    at = _nearest_list(x, c)
    # The rank of the lists in which sampled queries' true neighbours lie.
    ask = rng.choice(len(x), min(256, len(x)), replace=False)
    near = x[ask] @ x.T
    near[np.arange(len(ask)), ask] = -9
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(ask), 0), int)
    place = np.argsort(np.argsort(-(x[ask] @ c.T), axis=1), axis=1)
    ranks = np.sort(np.concatenate([place[i][at[b]] for i, b in enumerate(best)])) if best.size else np.zeros(1, int)
    return Index(turn, c, int(ranks[min(len(ranks) - 1, math.ceil(RECALL * len(ranks)))]) + 1)


def rounded(gap: np.ndarray) -> np.ndarray:
    """Distances to six digits or so: what differs less is rotation's rounding."""
    scale = 2.0 ** (np.floor(np.log2(np.maximum(gap, 1e-30))) - 19)
    return np.round(gap / scale) * scale


def scan(queries: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray | None = None, block: int = BLOCK, sure: float = SURE) -> list[np.ndarray]:
    """For each query its nearest rows by rounded squared distance, then id: 4 * k at most, as far as the tests are right.

    Coordinates are taken block by block; a row goes once its partial distance says that it is farther than
    the k-th nearest of those measured in full so far.
    """
    n, d = rows.shape
    ids = np.arange(n) if ids is None else ids
    by_block = [np.ascontiguousarray(rows[:, b : b + block]) for b in range(0, d, block)]
    out = []
    for q in queries:
        alive, part, limit = np.arange(n), np.zeros(n), np.inf
        for j, own in enumerate(by_block):
            diff = own[alive] - q[j * block : j * block + block] if len(alive) < n else own - q[j * block : j * block + block]
            part = part + np.einsum("ij,ij->i", diff, diff)
            seen = min(d, (j + 1) * block)
            if seen == d or len(alive) <= k:
                continue
            # The likeliest rows are measured in full: the limit tightens block by block.
            first = alive[np.argpartition(part, 2 * k - 1)[: 2 * k]] if len(alive) > 2 * k else alive
            full = ((rows[first] - q) ** 2).sum(1)
            limit = min(limit, np.partition(full, k - 1)[k - 1] * (1 + 1e-6) + 1e-9)
            keep = (part * (d / seen) <= limit * (1 + sure / math.sqrt(seen)) ** 2) & (part <= limit)
            alive, part = alive[keep], part[keep]
        order = np.lexsort((ids[alive], rounded(part)))[: 4 * k]
        out.append(alive[order])
    return out


def _cells(index, sizes: np.ndarray | None = None, least: int = 0):
    """The list of each vector; or, with the lists' sizes, those that a query probes: nearest centroids in rotated space.

    A query probes `probes` lists and as many more as it takes to have `least` vectors.
    """

    def run(frames):
        made: Index = index.value
        for pdf in frames:
            if pdf.empty:
                continue
            x = unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)) @ made.rotation
            near = -(x @ made.centroids.T)
            if sizes is not None:
                order = np.argsort(near, axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
                lists = [o[: max(made.probes, n)] for o, n in zip(order, enough)]
                yield pdf[["node"]].assign(lists=lists, turned=list(x.astype(np.float32)))
            else:
                yield pdf[["node", "first"]].assign(list=np.argmin(near, axis=1).astype(np.int32), turned=list(x.astype(np.float32)))

    return run


def _search(k: int):
    """The pairs of a list's part and a part of its queries that stay after the scan."""

    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query": [], "node": [], "first": [], "gap": []}).astype({"query": "int64", "node": "int64", "first": "int64", "gap": "float64"})
        x, q = np.stack(rows["turned"].to_numpy()), np.stack(queries["turned"].to_numpy())
        ids = rows["first"].to_numpy()
        found = scan(q, x, k, ids)
        node, name = rows["node"].to_numpy(), queries["node"].to_numpy()
        at = np.repeat(np.arange(len(q)), [len(f) for f in found])
        flat = np.concatenate(found)
        return pd.DataFrame({"query": name[at], "node": node[flat], "first": ids[flat], "gap": rounded(((x[flat] - q[at]) ** 2).sum(1).astype(np.float64))})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query, its own id left out."""
    numbers = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    able = vectors.where(numbers).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    width = able.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], empty)
    able = able.where(F.size("embedding") == width["d"])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    able = able.withColumn("norm", F.sqrt(dot("embedding", "embedding"))).where("norm > 0 and norm < double('infinity')")
    able = settled(able.withColumn("node", F.xxhash64(F.transform("embedding", lambda v: F.round(v / F.col("norm"), DIGITS) + 0.0))))
    # Of each direction the k + 1 smallest ids can be among any query's k nearest.
    ids = _smallest(able, k + 1)
    nodes = settled(ids.groupBy("node").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("first")))
    asked = settled(able.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("node", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm")))
    rows = nodes.count()
    if not rows:
        return vectors.sparkSession.createDataFrame([], empty)
    sample = nodes.orderBy(F.xxhash64("node")).limit(sample_rows(rows, width["d"])).toPandas()
    index = vectors.sparkSession.sparkContext.broadcast(train(np.stack(sample["embedding"].to_numpy()), rows, k))
    listed = settled(nodes.mapInPandas(_cells(index), "node long, first long, list int, turned array<float>"))
    held = np.zeros(len(index.value.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():  # MOST_LISTS rows at most
        held[r["list"]] = r["count"]
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts"))
    ask_nodes = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    probes = settled(ask_nodes.mapInPandas(_cells(index, held, k + 1), "node long, lists array<int>, turned array<float>").select("node", "turned", F.explode("lists").alias("list")))
    waves = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("waves"))
    plan = F.broadcast(sizes.join(waves, "list"))  # a row for each list, of which there are at most MOST_LISTS
    part = F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part")
    wave = F.pmod(F.xxhash64("node", F.lit(2)), "waves").cast("int").alias("wave")
    left = listed.join(plan, "list").select("node", "first", "turned", "list", part, F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"))
    right = probes.join(plan, "list").select("node", "turned", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), wave)
    key = ["list", "part", "wave"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k + 1), "query long, node long, first long, gap double")
    # Of each query's finds the nearest by rotated distance, with room for rounding, are ranked exactly.
    order = Window.partitionBy("query").orderBy("gap", "first", "node")
    kept = settled(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= 4 * (k + 1)).select("query", "node"))
    pairs = asked.withColumnRenamed("node", "query").join(kept, "query").join(ids, "node").where("vec_id <> query_id")
    ranked = pairs.withColumn("score", dot("q", "embedding") / (F.col("q_norm") * F.col("norm"))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _smallest(able: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """The n smallest ids of each node, first within salts, so that no task ranks all vectors of a common direction."""
    salted = able.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    for keys in (("node", "salt"), ("node",)):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= n)
    return settled(salted.select("node", "vec_id", "embedding", "norm"))


def adaptive_scan(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k)
