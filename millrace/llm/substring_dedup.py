"""Substring dedup: words covered by a window that begins in an earlier document too are removed.

Documents are dealt into groups by hash; that shuffle is the only one of the texts. A count-min sketch
goes first: each group sends, for every range of the window hashes, the cells its windows fall into,
the groups' sketches merge range by range, and only cells counted twice or more go back to the groups
that hold them. A cell never undercounts, so no repeated window is lost. The sketch has one row of
2 ** 27 cells a range, ranges in proportion to the input, of which only the cells in use are kept, as
ordered lists; so nothing is broadcast and no task holds more than one range. The second pass groups the
windows estimated repeated by 96-bit hashes: a group sends each once, with its earliest document there,
and hears which begin earlier elsewhere. Whole copies of an earlier text skip both passes.

Both merges have two levels beyond GROUPS_EACH groups: a range's groups merge in sets of that many first,
and a set passes a cell on twice at most and a window once. So a line that every group holds adds to a
range's second level two entries a set, not one a group.

Defined results: null text counts as empty; a text of fewer than `k` words keeps all; a null doc_id
is neither earlier nor later than any other; equal doc_ids are not earlier than each other; a very long
text is a group of its own at most; an empty table gives an empty result; columns besides doc_id and text
are ignored. doc_id is an integer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import keyed_join, pack_cells, runs, settled, slices, spread, unpack_cells, word_hashes

#: Windows in a sketch range and bytes of text in a document group, about; groups that merge at the first level.
PER_RANGE, PER_GROUP, GROUPS_EACH = 4_000_000, 2_000_000, 1_024
#: The order of a null doc_id: after all others.
LAST = np.iinfo(np.int64).max


def windows(texts: list[bytes], k: int, seed: int = 11) -> list[np.ndarray]:
    """Hashes of the windows of each text, in order."""
    out = []
    for i, j in slices(texts):
        words, bounds = word_hashes(texts[i:j], seed=seed)
        every = runs(words, k)
        out += [every[a : max(a, b - k + 1)] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _places(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and cell of window hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64), (keys.astype(np.uint32) >> np.uint32(5))


def _texts(docs: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The group's texts, copies as empty ones, and the order of their ids."""
    texts = docs.column("text").cast(pa.binary()).to_pylist()
    copies = docs.column("copy").to_pylist()
    ids = docs.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
    return [b"" if c else t for t, c in zip(texts, copies)], ids


def _split(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the stretches of equal values."""
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[i]), i, j) for i, j in zip(cuts, cuts[1:]) if j > i]


def _sketch(k: int, ranges: int):
    """For each range: the cells of the group's windows in order, a cell twice at most."""

    def run(docs: pa.Table) -> pa.Table:
        own = windows(_texts(docs)[0], k)
        part, cells = _places(np.concatenate(own), ranges)
        order = np.lexsort((cells, part))
        part, cells = part[order], cells[order]
        third = np.zeros(len(cells), bool)
        third[2:] = (part[2:] == part[:-2]) & (cells[2:] == cells[:-2])
        part, cells = part[~third], cells[~third]
        out = [(p, pack_cells(cells[i:j])) for p, i, j in _split(part)]
        group = docs.column("group")[0].as_py()
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "group": pa.array([group] * len(out), pa.int32()), "cells": pa.array([x[1] for x in out], pa.binary())})

    return run


def _often(cells: np.ndarray) -> np.ndarray:
    """Which of the cells occur twice or more."""
    order = np.argsort(cells, kind="stable")
    same = cells[order][1:] == cells[order][:-1]
    often = np.zeros(len(cells), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return often


def _cells_of(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a range's rows, and the row's number for each."""
    own = [unpack_cells(x) for x in table.column("cells").to_pylist()]
    return np.concatenate(own), np.repeat(table.column(name).to_numpy(), [len(x) for x in own])


def _by_number(numbers: np.ndarray, cells: np.ndarray, part: int, name: str) -> pa.Table:
    """(name, part, cells): each number's distinct cells in order."""
    order = np.lexsort((cells, numbers))
    out = [(g, pack_cells(np.unique(cells[order][i:j]))) for g, i, j in _split(numbers[order])]
    return pa.table({name: pa.array([x[0] for x in out], pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "cells": pa.array([x[1] for x in out], pa.binary())})


def _merged(table: pa.Table) -> pa.Table:
    """The cells of each group that the merged sketch of this range counts twice or more."""
    cells, group = _cells_of(table, "group")
    often = _often(cells)
    return _by_number(group[often], cells[often], table.column("part")[0].as_py(), "group")


def _merged_set(table: pa.Table) -> pa.Table:
    """First level: the cells of a set of groups, in order, each twice at most."""
    cells = np.sort(_cells_of(table, "group")[0])
    third = np.zeros(len(cells), bool)
    third[2:] = cells[2:] == cells[:-2]
    one = table.slice(0, 1)
    return pa.table({"part": one.column("part"), "held": one.column("held"), "cells": pa.array([pack_cells(cells[~third])], pa.binary())})


def _merged_sets(table: pa.Table) -> pa.Table:
    """Second level: the cells of each set that all sets together count twice or more."""
    cells, held = _cells_of(table, "held")
    often = _often(cells)
    return _by_number(held[often], cells[often], table.column("part")[0].as_py(), "held")


def _told_groups(sketches: pa.Table, often: pa.Table) -> pa.Table:
    """Of each group in a set the cells that the second level counted twice or more."""
    if not sketches.num_rows or not often.num_rows:
        return _by_number(np.zeros(0, np.int32), np.zeros(0, np.uint32), 0, "group")
    cells, group = _cells_of(sketches, "group")
    hit = np.isin(cells, np.concatenate([unpack_cells(x) for x in often.column("cells").to_pylist()]))
    return _by_number(group[hit], cells[hit], sketches.column("part")[0].as_py(), "group")


def _earliest(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, ...]:
    """All four in order of window, then id, and which rows begin a new window."""
    order = np.lexsort((ids, h2, h1))
    h1, h2, ids, tag = h1[order], h2[order], ids[order], tag[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1, h2, ids, tag, new


def _hashes(texts: list[bytes], ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    own, other = windows(texts, k), windows(texts, k, seed=12)
    at = np.repeat(np.arange(len(texts)), [len(x) for x in own])
    return np.concatenate(own), np.concatenate(other).astype(np.uint32), ids[at], at


def _repeated(k: int, ranges: int):
    """For each range: the group's windows that the sketch estimates repeated, with the earliest document of each."""

    def run(docs: pa.Table, cells: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and cells.num_rows:
            group = docs.column("group")[0].as_py()
            often = np.sort(np.concatenate([unpack_cells(x).astype(np.int64) + (p << 32) for p, x in zip(cells.column("part").to_pylist(), cells.column("cells").to_pylist())]))
            h1, h2, ids, _ = _hashes(*_texts(docs), k)
            part, cell = _places(h1, ranges)
            place = (part << 32) + cell
            hit = often[np.minimum(np.searchsorted(often, place), len(often) - 1)] == place
            h1, h2, ids, part, new = _earliest(h1[hit], h2[hit], ids[hit], part[hit])
            # Ordered by hash, windows are ordered by range.
            for p, i, j in _split(part[new]):
                out.append((p, group, *(x[new][i:j].tobytes() for x in (h1, h2, ids))))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "group", "h1", "h2", "ids"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

    return run


def _windows_of(table: pa.Table, name: str) -> tuple[np.ndarray, ...]:
    """h1, h2 and ids of all rows' windows, and the row's number for each."""
    h1, h2, ids = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h1", "<u8"), ("h2", "<u4"), ("ids", "<i8")))
    return h1, h2, ids, np.repeat(table.column(name).to_numpy(), [len(x) // 8 for x in table.column("h1").to_pylist()])


_WINDOWS = ("h1", "h2", "ids")


def _gone(group: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.Table:
    order = np.argsort(group, kind="stable")
    out = [(g, h1[order][i:j].tobytes(), h2[order][i:j].tobytes()) for g, i, j in _split(group[order])]
    return pa.table({"group": pa.array([x[0] for x in out], pa.int32()), "gone1": pa.array([x[1] for x in out], pa.binary()), "gone2": pa.array([x[2] for x in out], pa.binary())})


def _late(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of ordered windows: those that begin in an earlier document too."""
    return ids > ids[new][np.cumsum(new) - 1] if len(ids) else np.zeros(0, bool)


def _elsewhere(table: pa.Table) -> pa.Table:
    """The windows of each group that begin in an earlier document of another."""
    h1, h2, ids, group, new = _earliest(*_windows_of(table, "group"))
    late = _late(ids, new)
    return _gone(group[late], h1[late], h2[late])


def _least_of_set(table: pa.Table) -> pa.Table:
    """First level: a set's windows, each with its earliest document there."""
    h1, h2, ids, _, new = _earliest(*_windows_of(table, "group"))
    one = table.slice(0, 1)
    return pa.table({"part": one.column("part"), "held": one.column("held"), **{n: pa.array([x[new].tobytes()], pa.binary()) for n, x in zip(_WINDOWS, (h1, h2, ids))}})


def _least_of_sets(table: pa.Table) -> pa.Table:
    """Second level: for each set the windows that begin earlier in another, with the earliest document of all."""
    h1, h2, ids, held, new = _earliest(*_windows_of(table, "held"))
    least = ids[new][np.cumsum(new) - 1] if len(ids) else ids
    late = ids > least
    order = np.argsort(held[late], kind="stable")
    part = table.column("part")[0].as_py()
    out = [(part, g, *(x[late][order][i:j].tobytes() for x in (h1, h2, least))) for g, i, j in _split(held[late][order])]
    cols = list(zip(*out)) or [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "held", *_WINDOWS), cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3))})


def _told_windows(found: pa.Table, least: pa.Table) -> pa.Table:
    """The windows of each group in a set that begin in an earlier document, of the set or of another."""
    if not found.num_rows:
        return _gone(np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    own = _windows_of(found, "group")
    if least.num_rows:
        more = _windows_of(least, "held")
        own = [np.concatenate([a, b]) for a, b in zip(own, (*more[:3], np.full(len(more[0]), -1)))]
    h1, h2, ids, group, new = _earliest(*own)
    late = _late(ids, new) & (group >= 0)
    return _gone(group[late], h1[late], h2[late])


def _among(h1: np.ndarray, h2: np.ndarray, own1: np.ndarray, own2: np.ndarray) -> np.ndarray:
    """Which windows (h1, h2) are among the own ones: both hashes count."""
    order = np.lexsort((own2, own1))
    own1, own2 = own1[order], own2[order]
    first = np.searchsorted(own1, h1)
    most = int(np.bincount(np.cumsum(np.concatenate([[True], own1[1:] != own1[:-1]]))).max()) if len(own1) else 0
    hit = np.zeros(len(h1), bool)
    for k in range(most):
        at = np.minimum(first + k, len(own1) - 1)
        hit |= (own1[at] == h1) & (own2[at] == h2)
    return hit


def _kept(k: int):
    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        texts, ids = _texts(docs)
        counts, removed, kept = [], [], []
        hits = {}
        if len(texts):
            h1, h2, of, at = _hashes(texts, ids, k)
            first = np.cumsum([0, *np.bincount(at, minlength=len(texts))])
            place = np.arange(len(h1)) - first[at]
            _, _, sid, tag, new = _earliest(h1, h2, of, np.arange(len(h1)))
            late = _late(sid, new)
            drop = np.zeros(len(h1), bool)
            drop[tag[late]] = True
            if gone.num_rows:
                drop |= _among(h1, h2, np.frombuffer(b"".join(gone.column("gone1").to_pylist()), "<u8"), np.frombuffer(b"".join(gone.column("gone2").to_pylist()), "<u4"))
            drop &= of != LAST
            at, place = at[drop], place[drop]
            hits = {d: place[i:j] for d, i, j in _split(at)}
        whole = docs.column("text").cast(pa.binary()).to_pylist()
        for i, (text, copy) in enumerate(zip(whole, docs.column("copy").to_pylist())):
            words = text.split()
            n = len(words)
            if copy and n >= k:
                words = []
            elif i in hits:
                starts = hits[i]
                cover = np.bincount(starts, minlength=n + k) - np.bincount(starts + k, minlength=n + k)
                words = [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return run


def remove_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space) of each row."""
    docs = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, groups = max(1, math.ceil(size / 6 / PER_RANGE)), max(1, math.ceil(size / PER_GROUP))
    sets = math.ceil(groups / GROUPS_EACH)
    # Texts that occur once and empty ones have no copies to look for.
    marked = docs.withColumn("digest", F.md5("text"))
    least = settled(marked.where("text <> ''").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"))
    marked = keyed_join(marked, least, "digest", "left")
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")
    dealt = marked.select(group.alias("group"), "doc_id", "text", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"))
    # All uses of a group's documents read one shuffle.
    sketches = dealt.groupBy("group").applyInArrow(_sketch(k, ranges), "part int, group int, cells binary")
    if sets == 1:
        cells = sketches.groupBy("part").applyInArrow(_merged, "group int, part int, cells binary")
    else:
        sketches = settled(sketches.withColumn("held", F.pmod("group", F.lit(sets))))
        first = sketches.groupBy("part", "held").applyInArrow(_merged_set, "part int, held int, cells binary")
        often = first.groupBy("part").applyInArrow(_merged_sets, "held int, part int, cells binary")
        cells = sketches.groupBy("part", "held").cogroup(often.groupBy("part", "held")).applyInArrow(_told_groups, "group int, part int, cells binary")
    found = dealt.groupBy("group").cogroup(cells.groupBy("group")).applyInArrow(_repeated(k, ranges), "part int, group int, h1 binary, h2 binary, ids binary")
    gone_schema = "group int, gone1 binary, gone2 binary"
    if sets == 1:
        gone = found.groupBy("part").applyInArrow(_elsewhere, gone_schema)
    else:
        found = settled(found.withColumn("held", F.pmod("group", F.lit(sets))))
        window = "part int, held int, h1 binary, h2 binary, ids binary"
        earliest = found.groupBy("part", "held").applyInArrow(_least_of_set, window).groupBy("part").applyInArrow(_least_of_sets, window)
        gone = found.groupBy("part", "held").cogroup(earliest.groupBy("part", "held")).applyInArrow(_told_windows, gone_schema)
    schema = dealt.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return dealt.groupBy("group").cogroup(gone.groupBy("group")).applyInArrow(_kept(k), schema)


def substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, 13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
f AS (SELECT seq, min(doc_id) AS least FROM g GROUP BY seq),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (seq), range(13) AS r(j) WHERE least < doc_id),
k AS (SELECT d.doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
t AS (SELECT k.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM k ANTI JOIN c USING (doc_id, p) GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
