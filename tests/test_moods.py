"""Moods as a stream, against the view over all rows and a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming.moods import stream_moods

RECORD = "owner_id long, kind string, id long, status string, reduces_risk boolean, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


@pytest.fixture
def moods(spark, tmp_path):
    """Batches of records (owner, kind, id, status, risk, hours) to the rows given out by each."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def run(batches):
        given = []
        take = lambda df, n: given.extend((r.owner_id, r.mood, r.at) for r in df.collect())
        for k, batch in enumerate(batches):
            rows = [(*r[:5], None if r[5] is None else START + timedelta(hours=r[5])) for r in batch]
            spark.createDataFrame(rows, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(RECORD).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
            stream_moods(source).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return given

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def opp(owner, ident, status, risk, hours):
    return owner, "opportunity", ident, status, risk, hours


def done(owner, ident, hours):
    return owner, "resolved", ident, None, None, hours


def said(owner, kind, hours):
    return owner, kind, None, None, None, hours


def test_moods_change_and_lapse(moods):
    """Lapses without a row of the owner's, resolutions before their opportunity, rows that come again, nulls and other kinds."""
    given = moods([
        [said(1, "correction", 0), said(1, "observation", 40), said(2, "observation", 0), opp(3, 1, "interrupt", True, 1), opp(3, 2, "brief", None, 1), done(4, 9, 1), said(5, "other", 1), said(None, "correction", 1), said(6, "correction", None)],
        [said(2, "other", 50), opp(3, 1, "interrupt", True, 51), done(3, 1, 52), opp(4, 9, "interrupt", False, 52)],
        [done(3, 2, 60), done(3, 2, 60), said(9, "other", 70)],
    ])
    by = {}
    for owner, mood, at in given:
        by.setdefault(owner, []).append((mood, (at - START) / timedelta(hours=1)))
    assert by[1] == [("happy", 40), ("thinking", 48), ("calm", 64)]
    assert by[2][0] == ("thinking", 0) and by[2][-1][0] == "calm" and len(by[2]) == 2
    assert by[3] == [("protective", 1), ("curious", 52), ("calm", 60)]
    assert by[4] == [("calm", 1)] and by[5] == [("calm", 1)] and by[9] == [("calm", 70)]
    assert not {None, 6} & set(by)


def test_last_moods_equal_a_loop(moods):
    """Whatever the micro-batches, the last moods are those at the stream's largest time."""
    rng, rows = random.Random(2), []
    for h in range(0, 240, 2):
        owner = rng.choice([1, 1, 1, 2, 3, 4, 5])
        kind = rng.choice(["opportunity", "resolved", "correction", "observation"])
        rows.append((owner, kind, rng.randrange(6), rng.choice(["interrupt", "brief", "hold"]), rng.random() < 0.3, h))
    held = {}
    for owner, kind, ident, status, risk, h in rows:
        s = held.setdefault(owner, {"level": {}, "gone": set(), "correction": -999, "observation": -999})
        if kind == "opportunity":
            level = 0 if status == "interrupt" and risk else {"interrupt": 1, "brief": 2}.get(status)
            if level is not None:
                s["level"].setdefault(ident, level)
        elif kind == "resolved":
            s["gone"].add(ident)
        else:
            s[kind] = h
    want, now = {}, rows[-1][5]
    for owner, s in held.items():
        levels = [v for k, v in s["level"].items() if k not in s["gone"]]
        want[owner] = ("protective", "charged", "curious")[min(levels)] if levels else "happy" if s["correction"] > now - 48 else "thinking" if s["observation"] > now - 24 else "calm"
    given = moods([rows[:50], rows[50:]])
    assert {o: m for o, m, _ in given} == want and len(set(want.values())) > 1


def test_state_is_asked_for_once_a_block(monkeypatch):
    """Two calls to the store for each block of ids that a micro-batch touches, none to write what stays; the counts are a loop's."""
    import numpy as np

    from millrace.streaming import moods

    stored, calls = {}, []

    class Known:
        def getValue(self, key):
            calls.append(key)
            return stored.get(key)

        def updateValue(self, key, value):
            calls.append(key)
            stored[key] = value

    processor, rng = moods.Moods(), np.random.default_rng(3)
    processor._known = Known()
    held, level, gone = dict.fromkeys(moods.LEVELS, 0), {}, set()
    for _ in range(6):
        ids, said = rng.integers(-40_000, 40_000, 30_000), rng.choice([1, 2, 3, 4], 30_000).astype("i1")
        for i, x in zip(ids.tolist(), said.tolist()):
            gone.add(i) if x == moods.RESOLVED else level.setdefault(i, x)
        calls.clear()
        processor._count(held, ids, said)
        assert len(calls) == 2 * len({i >> moods.BLOCK_BITS for i in ids.tolist()}) == 12
        assert [*held.values()] == [sum(v == k and i not in gone for i, v in level.items()) for k in (1, 2, 3)]
    processor._count(held, ids, said)
    assert len(calls) == 12 + 6
