"""The fold as a stream: runs of micro-batches over a compacted base, against the batch fold and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import priorities
from millrace.streaming import fold

EVENT = "owner_id long, seq long, context string, higher string, lower string, confidence double"


def some_events(n, seed, hot=0.0):
    rng = random.Random(seed)
    pairs = [("Speed", "cost"), ("COST", "speed"), ("cost", "Speed"), ("a", "b")]
    found = []
    for i in range(n):
        owner, context, pair = (1, "Hot", rng.choice(pairs[:3])) if rng.random() < hot else (rng.choice([1, 2, None]), rng.choice(["x", "X", "y", None]), rng.choice(pairs))
        found.append((owner, i, context, *pair, rng.choice([None] * 9 + [0.6, 0.1])))
    return found


def by_loop(batches):
    """The fold, one event after the other, as they arrive."""
    held = {}
    for batch in batches:
        for owner, seq, context, higher, lower, conf in sorted(batch, key=lambda e: e[1]):
            h, w = higher.lower(), lower.lower()
            key, side = (owner, context and context.lower(), min(h, w), max(h, w)), int(h > w)
            s, n, first, names = held.get(key, (0, 0, (seq, context), None))
            to = priorities.transition(s, side) if conf is None else 1 + 101 * side + round(min(max(conf, 0.05), 0.99) * 100)
            if s == 0 or conf is not None or (to - 1) // 101 != (s - 1) // 101:
                names = (higher, lower)
            held[key] = to, 1 if s == 0 else n + (conf is None), first, names
    return sorted((str(k[0]), *map(str, first), *names, (s - 1) % 101, n) for k, (s, n, first, names) in held.items())


def listed(rows):
    return sorted((str(r.owner_id), str(r.seq), str(r.context), r.higher, r.lower, round(float(r.confidence) * 100), r.evidence) for r in rows.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize("every", [1, 2])
def test_batches_equal_a_loop(spark, tmp_path, every):
    """Late seqs, null keys, letters in either case, and bases after each or each second micro-batch."""
    events, path = some_events(240, seed=every), str(tmp_path / "p")
    random.Random(3).shuffle(events)
    batches = [events[k : k + 60] for k in range(0, 240, 60)]
    for k, batch in enumerate(batches):
        fold.add_batch(frame(spark, batch), path, k + 1, every=every)
        if k >= 2:
            assert listed(fold.stored_priorities(spark, path)) == by_loop(batches[: k + 1])


def test_a_hot_key_in_one_batch(spark, tmp_path):
    """Over a third of a micro-batch in one key, cut into runs of 16 seqs: lists, tables and their joins."""
    events, path = some_events(1500, seed=4, hot=0.4), str(tmp_path / "p")
    batches = [events[:900], events[900:]]
    for k, batch in enumerate(batches):
        fold.add_batch(frame(spark, batch), path, k + 1, bits=4)
    runs = priorities.event_runs(priorities.keyed(frame(spark, events)), 4)
    assert runs.agg(F.max("run.n")).first()[0] <= 16 and runs.where("ckey = 'hot'").count() > 50
    stored = spark.read.parquet(f"{path}/runs/v-000000000001")
    assert stored.groupBy(*priorities.KEY).count().agg(F.max("count")).first()[0] == 1
    assert listed(fold.stored_priorities(spark, path)) == by_loop(batches)


def test_a_batch_counts_once(spark, tmp_path):
    """Again before and after it went into the base; empty ones; a fold of nothing; changes since a version."""
    events, path = some_events(90, seed=5), str(tmp_path / "p")
    with pytest.raises(ValueError):
        fold.stored_priorities(spark, path)
    batches = [events[:30], [], events[30:60], events[60:]]
    for k, batch in enumerate(batches):
        for _ in range(2):
            fold.add_batch(frame(spark, batch), path, k + 1)
        if k == 2:
            assert fold.compact(spark, path) == 3 and fold.compact(spark, path) == 3
            fold.add_batch(frame(spark, batch), path, k + 1)
    assert listed(fold.stored_priorities(spark, path)) == by_loop(batches)
    all_rows, changed = by_loop(batches), listed(fold.stored_priorities(spark, path, since=3))
    keys = {(str(o), str(c and c.lower()), *sorted((h.lower(), w.lower()))) for o, _, c, h, w, _ in batches[-1]}
    assert changed == [r for r in all_rows if (r[0], "None" if r[2] == "None" else r[2].lower(), *sorted((r[3].lower(), r[4].lower()))) in keys]
    assert listed(fold.stored_priorities(spark, path, since=4)) == []


def test_versions_go_and_readers_stay(spark, tmp_path):
    """A reader of the base before still reads after a compaction; what that one needed goes with the next."""
    events, path = some_events(90, seed=6), str(tmp_path / "p")
    fold.add_batch(frame(spark, events[:30]), path, 1)
    fold.compact(spark, path)
    fold.add_batch(frame(spark, events[30:60]), path, 2)
    reader = fold.stored_priorities(spark, path)
    fold.compact(spark, path)
    assert listed(reader) == by_loop([events[:30], events[30:60]])
    fold.add_batch(frame(spark, events[60:]), path, 3)
    fold.compact(spark, path)
    assert fold._versions(spark, f"{path}/base") == [2, 3] and fold._versions(spark, f"{path}/runs") == [3]
    assert listed(fold.stored_priorities(spark, path)) == by_loop([events[:30], events[30:60], events[60:]])


def test_owner_filter_reaches_the_files(spark, tmp_path):
    events, path = some_events(90, seed=7), str(tmp_path / "p")
    fold.add_batch(frame(spark, events[:60]), path, 1, every=1)
    fold.add_batch(frame(spark, events[60:]), path, 2)
    plan = fold.stored_priorities(spark, path).where("owner_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(owner_id,2)") == 2, plan


def test_stream_equals_batch(spark, tmp_path):
    """Three files, one a micro-batch; a restarted query goes on where it was."""
    events, path = some_events(120, seed=9), str(tmp_path / "p")

    def run():
        source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        fold.stream_priorities(source, path, every=2).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    for k in range(3):
        frame(spark, events[k * 40 : k * 40 + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k:
            run()
    assert listed(fold.stored_priorities(spark, path)) == listed(priorities.fold_priorities(frame(spark, events)))
