"""The confidence fold as a stream: runs of each micro-batch over a compacted table of states.

A micro-batch is folded by Spark as the log is, in runs of seqs, to one run a key: a third of all rows in one
key is cut like any other key, and no Python worker takes part. Its runs are stored as a version of their own (`runs/v-`), named by
the micro-batch, so one that comes again after a failure counts once. After `every` micro-batches the states that the
runs lead to become a new base (`base/v-`); what is current is the base and the runs after it, so neither a read nor a
compaction goes over the whole log.

Order is arrival order: by micro-batch, then by seq. Event time plays no part, so there is no watermark and a
key's state stays. Empty micro-batches leave no version. Ids may be null: null keys are one key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from millrace.operators.priorities import HELD, KEY, RUN_BITS, as_priorities, batch_runs, resumed
from millrace.sources.shared import file_at, removed
from millrace.sources.store import current_version, numbered

#: Micro-batches after which their runs go into the base: a key's list has twice as many runs at most.
EVERY = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, at = file_at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def _at(path: str, version: int) -> str:
    return f"{path}/v-{version:012d}"


def _saved(rows: DataFrame, path: str, version: int) -> None:
    """rows as that version, whole or not at all; where it is there already, that one stays."""
    spark, new = rows.sparkSession, f"_new-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{new}")
    if not numbered(spark, new, path, version):
        removed(spark, f"{path}/{new}")


def add_batch(events: DataFrame, path: str, version: int, bits: int = RUN_BITS[0], every: int = EVERY) -> None:
    """Events as the runs of a version (from 1); nothing happens if it is there or in the base. A base is made when it is due."""
    spark = events.sparkSession
    if version > current_version(spark, f"{path}/base") and version not in _versions(spark, f"{path}/runs"):
        if events.isEmpty():
            return
        _saved(batch_runs(events, bits), f"{path}/runs", version)
    if len(_tail(spark, path)) >= every:
        compact(spark, path)


def _tail(spark: SparkSession, path: str, after: int | None = None) -> list[int]:
    after = current_version(spark, f"{path}/base") if after is None else after
    return [v for v in _versions(spark, f"{path}/runs") if v > after]


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    """KEY, version, held of the base and the runs after it; None before the first."""
    base = current_version(spark, f"{path}/base")
    tail = _tail(spark, path, base)
    held = spark.read.parquet(_at(f"{path}/base", base)) if base else None
    if not tail:
        return held
    runs = spark.read.option("basePath", f"{path}/runs").parquet(*(_at(f"{path}/runs", v) for v in tail))
    # A version's folder names it.
    runs = runs.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), r"/v-(\d+)/[^/]*$", 1).cast("long"))
    if held is None:
        held = runs.select(*KEY, "version", F.lit(None).cast(HELD).alias("held")).limit(0)
    return resumed(held, runs)


def compact(spark: SparkSession, path: str) -> int:
    """The states as a new base, sorted by key so that a filter by owner reads little; its version.

    What the base before needs stays until the next compaction, for those who read it now.
    """
    before, tail = current_version(spark, f"{path}/base"), _tail(spark, path)
    if not tail:
        return before
    _saved(_states(spark, path).repartitionByRange(*KEY).sortWithinPartitions(*KEY), f"{path}/base", tail[-1])
    for kind, last in (("runs", before), ("base", before - 1)):
        for v in _versions(spark, f"{path}/{kind}"):
            if v <= last:
                removed(spark, _at(f"{path}/{kind}", v))
    return tail[-1]


def stream_priorities(events: DataFrame, path: str, bits: int = RUN_BITS[0], every: int = EVERY) -> DataStreamWriter:
    """A writer of streaming events into `path`, to be given a checkpoint location and started. One query writes a path."""
    return events.writeStream.outputMode("append").foreachBatch(lambda batch, n: add_batch(batch, path, n + 1, bits, every))


def stored_priorities(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """owner_id, seq, context, higher, lower, confidence, evidence as of the last micro-batch; with `since` those changed after that version.

    A filter by owner reaches the base's files.
    """
    states = _states(spark, path)
    if states is None:
        raise ValueError(f"{path} holds no micro-batch yet")
    changed = states.where(F.col("version") > since) if since else states
    return as_priorities(changed.select("owner_id", "held.seq", "held.context", "held.names.higher", "held.names.lower", "held.state", "held.evidence"))
