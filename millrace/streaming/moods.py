"""Owners' moods as a stream: what an owner's records say now, and what lapses when nothing more is said.

Input: owner_id, kind, id, status, reduces_risk, ts (timestamp, with a watermark). Kinds are `opportunity` (id, status,
reduces_risk), `resolved` (the id of an opportunity), `correction` and `observation`; others, and rows without an owner or time, change nothing.
State for each owner: how many open opportunities there are of each level, the time of the last correction and observation,
and a mark for each opportunity that counts, open or resolved, in blocks of 2^BLOCK_BITS ids: three bytes an opportunity, and two calls to the
state store for each block that a micro-batch touches. A row that comes again changes nothing, and a resolution may come before
its opportunity. Timers at the 48 and 24 hours after which a correction and an observation lapse do the rest.

Output: owner_id, at, mood, whenever a mood differs from the one given out before; an owner's first is given out whatever it
is. `at` is the largest time that the owner's rows have, or the time of the lapse. Within a micro-batch rows are taken as they come,
AT_ONCE of them at most put together, so memory is bounded for an owner of any size; what is between is not given out. Moods are as of the watermark: with no delay
and all rows read, the last ones are those of `views.owner_states` at the largest time of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.views import CORRECTION_HOURS, OBSERVATION_HOURS

#: Levels of opportunities, strongest first, and the moods that open ones and what is recent stand for.
LEVELS = ("protective", "charged", "curious")
LAPSES = {"correction": ("happy", CORRECTION_HOURS), "observation": ("thinking", OBSERVATION_HOURS)}
#: What a row says as a number: a level plus 1, that its opportunity is resolved, what lapses; other rows say only when they came.
RESOLVED, SAID, OTHER = 4, {"correction": 5, "observation": 6}, 0
HOUR = 3_600_000_000
#: Rows of opportunities that are put together before their state is asked for, and the bits of an id within its block.
AT_ONCE, BLOCK_BITS = 1 << 20, 14
#: A block's opportunities in order of their ids: the low bits of the id, and the mark (level plus 1, 0 if not known, plus RESOLVED).
MARKS = np.dtype([("low", "<u2"), ("mark", "u1")])


def marked(ids: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of some rows and their marks: the first level of each, and whether a row resolves it."""
    known, place = np.unique(ids, return_inverse=True)
    marks = np.zeros(len(known), "u1")
    leveled = said < RESOLVED
    some, first = np.unique(place[leveled], return_index=True)
    marks[some] = said[leveled][first]
    marks[place[~leveled]] |= RESOLVED
    return known, marks


def merged(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Marks of opportunities before and by later rows as one: a known level stays."""
    level = np.where(old % RESOLVED > 0, old % RESOLVED, new % RESOLVED)
    return (level | ((old | new) & RESOLVED)).astype("u1")


class Moods(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getValueState("held", "protective long, charged long, curious long, correction long, observation long, at long, mood string")
        self._known = handle.getMapState("known", "block long", "marks binary")

    def _read(self) -> dict:
        names = [*LEVELS, *LAPSES, "at", "mood"]
        return dict(zip(names, self._held.get() or (0, 0, 0, None, None, None, None)))

    def _count(self, held: dict, ids: np.ndarray, said: np.ndarray) -> None:
        """What rows say of some opportunities: a level counts from its first row until the opportunity is resolved."""
        known, marks = marked(ids, said)
        lows, blocks = (known & ((1 << BLOCK_BITS) - 1)).astype("<u2"), known >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        step = np.zeros(2 * RESOLVED, "i8")
        for begin, end in zip([0, *cuts], [*cuts, len(known)]):
            key, low, new = (int(blocks[begin]),), lows[begin:end], marks[begin:end]
            stored = self._known.getValue(key)
            if stored is None:
                done, now, before = (low, new), new, None
            else:
                own = np.frombuffer(bytes(stored[0]), MARKS)
                every = np.union1d(own["low"], low)
                held_marks = np.zeros(len(every), "u1")
                held_marks[np.searchsorted(every, own["low"])] = own["mark"]
                at = np.searchsorted(every, low)
                before = held_marks[at]
                now = merged(before, new)
                if (now == before).all():
                    continue
                held_marks[at] = now
                done = every, held_marks
            if before is not None:
                step -= np.bincount(before, minlength=2 * RESOLVED)
            step += np.bincount(now, minlength=2 * RESOLVED)
            packed = np.empty(len(done[0]), MARKS)
            packed["low"], packed["mark"] = done
            self._known.updateValue(key, (packed.tobytes(),))
        for level, name in enumerate(LEVELS):
            held[name] += int(step[level + 1])

    def _settle(self, key, held: dict) -> Iterator[pd.DataFrame]:
        """The mood as of the owner's time, given out if it is another, and the state kept."""
        now = held["at"]
        recent = [m for k, (m, hours) in LAPSES.items() if held[k] is not None and held[k] > now - hours * HOUR]
        mood = next((m for m in LEVELS if held[m] > 0), recent[0] if recent else "calm")
        changed, held["mood"] = mood != held["mood"], mood
        self._held.update(tuple(held.values()))
        if changed:
            yield pd.DataFrame({"owner_id": [key[0]], "micros": [now], "mood": [mood]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, some, waiting = self._read(), [], 0
        before = dict(held)
        for part in rows:
            said, micros = part["said"].to_numpy(), part["micros"].to_numpy()
            held["at"] = max(held["at"] or int(micros[0]), int(micros.max()))
            for k, number in SAID.items():
                own = micros[said == number]
                if len(own):
                    held[k] = max(held[k] or int(own[0]), int(own.max()))
            which = (said != OTHER) & (said <= RESOLVED)
            if which.any():
                some.append((part["id"].to_numpy()[which], said[which]))
                waiting += len(some[-1][0])
            if waiting >= AT_ONCE:
                self._count(held, *map(np.concatenate, zip(*some)))
                some, waiting = [], 0
        if some:
            self._count(held, *map(np.concatenate, zip(*some)))
        for k, (_, hours) in LAPSES.items():
            if held[k] != before[k]:
                # Milliseconds, rounded up: not before it has lapsed.
                self._handle.registerTimer(-(-(held[k] + hours * HOUR) // 1000))
        yield from self._settle(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._read()
        held["at"] = max(held["at"], expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield from self._settle(key, held)

    def close(self) -> None:
        pass


def stream_moods(records: DataFrame) -> DataFrame:
    """A streaming DataFrame of records to one of moods that changed, for update mode. Needs the RocksDB state store."""
    owner = dict(records.dtypes)["owner_id"]
    kind, high = F.col("kind"), F.col("status") == "interrupt"
    level = F.when(kind == "opportunity", F.when(high & F.coalesce("reduces_risk", F.lit(False)), 1).when(high, 2).when(F.col("status") == "brief", 3))
    of = F.when(F.col("id").isNotNull(), F.coalesce(level, F.when(kind == "resolved", RESOLVED)))
    said = F.coalesce(of, *(F.when(kind == k, number) for k, number in SAID.items()), F.lit(OTHER)).cast("byte")
    # Whole numbers without nulls stay whole in pandas.
    rows = records.where("owner_id IS NOT NULL AND ts IS NOT NULL").select("owner_id", F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), said.alias("said"), F.unix_micros("ts").alias("micros"), "ts")
    moods = rows.groupBy("owner_id").transformWithStateInPandas(Moods(), f"owner_id {owner}, micros long, mood string", "Update", "EventTime")
    return moods.select("owner_id", F.timestamp_micros("micros").alias("at"), "mood")
