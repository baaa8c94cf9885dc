"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Equal sets collapse first. A sketch of fixed size then estimates how many sets hold each gram, and
orders all grams from rare to common. Two sets of the wanted similarity share one of their first grams
in that order, whose number follows from the set's size, so the columns of the product are these grams.
Within each column the sets are compared by size and by a bitmap that each set carries (a bit per gram's
hash, flipped by each gram): bits that differ are grams that differ, which bounds the overlap from above,
and pairs below the bound that their sizes ask for go at once. Sets that are left are compared once more in the
columns that they share with sets of like size, by bitmaps that are as large as the sets: the small ones of fixed size tell
nothing of long texts. What is left then is joined into groups by a spanning forest, and within each group the product itself is taken: rows against columns, column block by
column block, overlap counts accumulate and a pair that can no longer reach its bound goes. A row is taken
against the rows that it isn't linked with yet, so a group of copies costs in proportion to its size.

Groups over `block` sets are dealt into blocks by hash. Some sets of the group go into every block, which
links the blocks' halves of one component; then every set outside the largest component is taken
against all blocks, so no pair is missed and only a spanning forest of the links ever leaves a task. The
sketch and the bitmaps decide what is compared: coarse ones cost time, never a link.

Defined results: a null or blank text has no grams, n_grams 0 and links with nothing; equal texts
share a component; a null doc_id counts as larger than all others; a very long text is one row of a
block, which is cut by bytes too; an empty table gives an empty result; columns besides doc_id and text
are ignored; repeated rows give repeated result rows.
"""

from __future__ import annotations

import copy
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import components, in_batches, keyed_join, lean, mix, pack_cells, runs, settled, sifted, slices, unpack_cells, word_hashes

#: Signatures that one reducer task gets together, about: with bitmaps, and those without that sets are compared by again.
PER_RANGE, PER_FINE = 1_200_000, 2_000_000
#: Sketch: 2 ** MOST_BITS cells of half a byte at most, in parts of 2 ** PART_BITS; grams that a task gathers before it sends them, and bytes of text whose sketches one task sums up, about.
MOST_BITS, PART_BITS, GATHERED, SUMMED = 26, 18, 1_500_000, 8_000_000_000
#: 64-bit words of a set's bitmap; bytes of text in a block, sets that go into every block of a group, rows and columns of a tile.
WORDS, BLOCK_BYTES, SHARED_SETS, TILE_ROWS, TILE_COLUMNS = 2, 8_000_000, 8, 128, 1_024
#: Bits at least of a bitmap that grows with its set.
LEAST_BITS = 512
#: Rows of a column that are compared pair by pair; rows of a batch's column beyond which close sets go on as one ball, and its radius in bits.
SMALL, MANY, RADIUS = 16, 64, 16


def gram_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word grams of each text; a shorter text is one gram as a whole."""
    out = []
    for i, j in slices(texts):
        words, bounds = word_hashes(texts[i:j], lower=True)
        grams = runs(words, k)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            else:
                out.append(runs(words[a:b] + np.uint64(b - a), int(b - a)) if b > a else words[:0])
    return out


def least_overlap(n: int, m: int, t: int) -> int:
    """Smallest overlap with 100 * overlap >= t * union for sizes n and m."""
    return -(-t * (n + m) // (100 + t))


def cell_of(grams: np.ndarray, bits: int) -> np.ndarray:
    """The sketch cell of each gram."""
    return (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketched(k: int, bits: int):
    """Per part of the sketch: the cells of the grams of a task's sets, one for each set and gram."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(held))
        part = cells >> np.uint32(PART_BITS)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        blobs = [pack_cells(cells[i:j] & np.uint32((1 << PART_BITS) - 1)) for i, j in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "cells"])

    @lean
    def run(batches):
        held, n = [], 0
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i, j in slices(texts, 4_000_000):
                held += [cell_of(s, bits) for s in gram_sets(texts[i:j], k) if len(s)]
                n = sum(map(len, held))
                if n >= GATHERED:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    return run


def _summed(last: bool):
    """Counts of each part's cells, whose rows come together; at last as levels of half a byte, the logarithm of the count."""

    def sent(part: int, n: np.ndarray) -> pa.RecordBatch:
        if last:
            level = np.minimum(np.log2(np.maximum(n, 1)), 15).astype(np.uint8)
            blob = (level[0::2] | level[1::2] << 4).tobytes()
        else:
            blob = b"\3" + np.minimum(n, (1 << 32) - 1).astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "cells"])

    @lean
    def run(batches):
        now, n = None, None
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                if part != now:
                    if now is not None:
                        yield sent(now, n)
                    now, n = part, np.zeros(1 << PART_BITS, np.int64)
                n += np.frombuffer(blob, "<u4", offset=1) if blob[0] == 3 else np.bincount(unpack_cells(blob), minlength=1 << PART_BITS)
        if now is not None:
            yield sent(now, n)

    return run


def commonness(docs: DataFrame, k: int, size: int) -> np.ndarray:
    """Levels of the sketch cells, two a byte, higher for grams of more sets; 2 ** MOST_BITS / 2 bytes at most."""
    bits = min(MOST_BITS, max(PART_BITS, (size // 4).bit_length()))
    parts = docs.mapInArrow(_sketched(k, bits), "part int, cells binary")
    if (salts := math.ceil(size / SUMMED)) > 1:
        salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition("part", "salt").sortWithinPartitions("part")
        parts = salted.select("part", "cells").mapInArrow(_summed(False), "part int, cells binary")
    levels = np.zeros((1 << bits - PART_BITS, 1 << PART_BITS - 1), np.uint8)
    for part, blob in parts.repartition("part").sortWithinPartitions("part").mapInArrow(_summed(True), "part int, cells binary").collect():
        levels[part] = np.frombuffer(blob, np.uint8)
    return levels.reshape(-1)


def first_grams(grams: np.ndarray, t: int, levels: np.ndarray) -> np.ndarray:
    """A set's first grams from rare to common; two sets of similarity t in percent share one.

    A gram that no other set holds (level 0) is left out.
    """
    n = len(grams)
    if not n:
        return grams
    cell = cell_of(grams, len(levels).bit_length())
    level = levels[cell >> np.uint32(1)] >> ((cell & np.uint32(1)) << np.uint32(2)).astype(np.uint8) & 15
    first = np.lexsort((grams, level))[: n + (-t * n // 100) + 1]
    return grams[first[level[first] > 0]]


class Forest:
    """Union-find over integers."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def bitmap(grams: np.ndarray, bits: int = 64 * WORDS) -> np.ndarray:
    """A bit for each hash, flipped by each gram: bits that differ between sets are grams that differ.

    The halves of a map of 2 ** n bits make the map of half the size: a bit of it is set where one of theirs is.
    """
    bit = mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(bits)
    odd = (np.bincount(bit.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def whole_bitmap(grams: np.ndarray) -> np.ndarray:
    """The bitmap of over half as many bits as grams, and of LEAST_BITS at least."""
    return bitmap(grams, max(LEAST_BITS, 1 << len(grams).bit_length() - 1))


def spanning(n: int, reached) -> list[tuple[int, int]]:
    """Pairs that connect what a relation on range(n) connects: reached(rows, others) gives the pairs that hold.

    A row is taken once, against those that none reached so far. What it reaches is taken next, in tiles. Rows
    that reach nothing are followed by ever larger tiles; a tile that meets something is taken again row by row.
    """
    out, left, frontier, step = [], np.arange(n), np.zeros(0, np.int64), 1
    while len(left):
        if len(frontier):
            rows, frontier, fresh = frontier[:TILE_ROWS], frontier[TILE_ROWS:], False
        else:
            rows, left, fresh = left[:step], left[step:], True
        a, b = reached(rows, left) if len(left) else (rows[:0], rows[:0])
        if fresh and len(rows) > 1 and (len(b) or np.not_equal(*reached(rows, rows)).any()):
            left, step = np.concatenate([rows, left]), 1
            continue
        b, first = np.unique(b, return_index=True)
        out += zip(a[first].tolist(), b.tolist())
        frontier = np.concatenate([frontier, b])
        left = left[~np.isin(left, b)] if len(b) else left
        if fresh:
            step = 1 if len(b) else min(2 * step, TILE_ROWS)
    return out


@dataclass
class Balls:
    """Sets, or sets with others around them: least size, largest size, bits that others differ by at most, bitmap."""

    low: np.ndarray
    high: np.ndarray
    radius: np.ndarray
    maps: np.ndarray

    def take(self, at: np.ndarray) -> Balls:
        return Balls(self.low[at], self.high[at], self.radius[at], self.maps[at])

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.maps[i] ^ self.maps[j]).sum(1, dtype=np.int64)

    def possible(self, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
        """Which pairs sizes and bitmaps don't rule out: sets around the two may differ by their radii less than these."""
        n, m = np.maximum(self.high[i], self.low[j]), np.maximum(self.high[j], self.low[i])
        # The closest sizes; where the ranges overlap they are equal.
        small = np.where(self.high[i] < self.low[j], self.high[i], np.where(self.high[j] < self.low[i], self.high[j], 1))
        large = np.where(self.high[i] < self.low[j], self.low[j], np.where(self.high[j] < self.low[i], self.low[i], 1))
        keep = small >= -(-t * (small + large) // (100 + t))
        n, m = self.high[i], self.high[j]
        apart = np.maximum(self.apart(i, j) - self.radius[i] - self.radius[j], 0)
        return keep & (n + m - apart >= 2 * -(-t * (n + m) // (100 + t)))


class Maps:
    """Rows of sets, whose bitmaps are as large as the sets: `row` is the set of each row."""

    def __init__(self, row: np.ndarray, size: np.ndarray, maps: list[np.ndarray]):
        self.row, self.size, self.level = row, size, np.array([len(m).bit_length() for m in maps], np.int64)
        self.place, self.maps = {}, {}
        for e in np.unique(self.level).tolist():
            # Sets of the next size up are here too, folded.
            own, next_up = np.flatnonzero(self.level == e), np.flatnonzero(self.level == e + 1)
            self.place[e] = np.full(len(maps), -1)
            self.place[e][np.concatenate([own, next_up])] = np.arange(len(own) + len(next_up))
            self.maps[e] = np.stack([*(maps[x] for x in own), *(maps[x][: len(maps[x]) // 2] ^ maps[x][len(maps[x]) // 2 :] for x in next_up)])

    def take(self, at: np.ndarray) -> Maps:
        out = copy.copy(self)
        out.row = self.row[at]
        return out

    def possible(self, i: np.ndarray, j: np.ndarray, t: int) -> np.ndarray:
        """Which pairs sizes and bitmaps don't rule out; maps that differ more than twofold in size rule out none."""
        a, b = self.row[i], self.row[j]
        n, m = self.size[a], self.size[b]
        need, low = least_overlap(n, m, t), np.minimum(self.level[a], self.level[b])
        keep = np.minimum(n, m) >= need
        tested = keep & (np.maximum(self.level[a], self.level[b]) <= low + 1)
        for e in np.unique(low[tested]).tolist():
            place, maps, at = self.place[e], self.maps[e], np.flatnonzero(tested & (low == e))
            step = max(1, (1 << 20) // maps.shape[1])
            for x in (at[c : c + step] for c in range(0, len(at), step)):
                apart = np.bitwise_count(maps[place[a[x]]] ^ maps[place[b[x]]]).sum(1, dtype=np.int64)
                keep[x] = n[x] + m[x] - apart >= 2 * need[x]
        return keep


def _pairs(rows: np.ndarray, others: np.ndarray, test) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows and others that pass the test, tile by tile."""
    found = []
    for c in range(0, len(others), TILE_COLUMNS):
        own = others[c : c + TILE_COLUMNS]
        i, j = np.repeat(rows, len(own)), np.tile(own, len(rows))
        keep = test(i, j)
        found.append((i[keep], j[keep]))
    a, b = zip(*found) if found else ([rows[:0]], [rows[:0]])
    return np.concatenate(a), np.concatenate(b)


def met(keys: np.ndarray, nodes: np.ndarray, balls: Balls | Maps, t: int) -> list[tuple[int, int]]:
    """A spanning forest over nodes of the possible pairs that share a key; a row for each key, node and ball."""
    order = np.lexsort((nodes, keys))
    keys, nodes, balls = keys[order], nodes[order], balls.take(order)
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    wide = np.diff(cuts)
    forest, out = Forest(), []

    def link(i, j):
        for a, b in set(zip(nodes[i].tolist(), nodes[j].tolist())):
            if a != b and forest.join(a, b):
                out.append((a, b))

    # Columns of few sets: all pairs, a step apart at a time.
    width = np.repeat(wide, wide)
    for d in range(1, SMALL):
        at = np.flatnonzero((width[d:] <= SMALL) & (keys[d:] == keys[:-d])) if len(keys) > d else np.zeros(0, np.int64)
        for c in range(0, len(at), 1 << 17):
            i, j = at[c : c + (1 << 17)], at[c : c + (1 << 17)] + d
            keep = balls.possible(i, j, t)
            link(i[keep], j[keep])
    for k in np.flatnonzero(wide > SMALL).tolist():
        rows = np.arange(cuts[k], cuts[k + 1])
        found = spanning(len(rows), lambda a, b: _pairs(a, b, lambda i, j: balls.possible(rows[i], rows[j], t)))  # noqa: B023
        if found:
            link(rows[[x for x, _ in found]], rows[[y for _, y in found]])
    return out


def gathered(keys: np.ndarray, nodes: np.ndarray, balls: Balls, t: int) -> tuple[np.ndarray, Balls, list[tuple[int, int]]]:
    """Rows that go on for a batch: of a key with many, sets close to another go with it as a ball. And what is linked so."""
    order = np.lexsort((nodes, keys))
    cuts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]]))
    stay, links = np.ones(len(keys), bool), []
    low, high, radius = balls.low.copy(), balls.high.copy(), balls.radius.copy()
    for k in np.flatnonzero(np.diff(cuts) > MANY).tolist():
        left = order[cuts[k] : cuts[k + 1]]
        while len(left) > 1:
            lead, left = left[0], left[1:]
            first = np.full(len(left), lead)
            apart = balls.apart(first, left)
            own = (apart <= RADIUS) & balls.possible(first, left, t)
            if own.any():
                low[lead], high[lead], radius[lead] = min(low[lead], balls.low[left[own]].min()), max(high[lead], balls.high[left[own]].max()), apart[own].max()
                links += [(int(nodes[lead]), int(nodes[x])) for x in left[own]]
                stay[left[own]] = False
                left = left[~own]
            elif len(left) > MANY:
                # A column of unlike sets: they go on as they are.
                break
    at = np.flatnonzero(stay)
    forest = Forest()
    return at, Balls(low, high, radius, balls.maps).take(at), [(a, b) for a, b in set(links) if a != b and forest.join(a, b)]


def set_id(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def short_id(node: bytes) -> int:
    """A set's name among candidates; that two sets share one costs time only."""
    return int.from_bytes(node[:8], "little", signed=True)


def _digests(k: int):
    @lean
    def run(batches):
        for b in batches:
            sets = gram_sets(b.column("text").cast(pa.binary()).to_pylist(), k)
            ids = [set_id(s) if len(s) else None for s in sets]
            short = pa.array([None if x is None else short_id(x) for x in ids], pa.int64())
            cols = [b.column("doc_id"), b.column("row"), b.column("bytes"), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), short]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "bytes", "n_grams", "node", "short"])

    return run


def packed(keys: np.ndarray, values: dict[str, np.ndarray], ranges: int, fields) -> list[tuple[int, bytes, int]]:
    """(range of keys, its rows as columns of bytes, their number), by range; nodes of a range stand together."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((values["nodes"], part))
    part, values = part[order], {n: x[order] for n, x in values.items()}
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[i]), b"".join(values[n][i:j].astype(kind).tobytes() for n, kind in fields), j - i) for i, j in zip(cuts, cuts[1:]) if j > i]


def unpacked(blobs, counts, fields) -> dict[str, np.ndarray]:
    """The columns of all blobs, one behind the other."""
    found = {n: [] for n, _ in fields}
    for blob, n in zip(blobs, counts):
        at = 0
        for name, kind in fields:
            count = n * WORDS if name == "maps" else n
            found[name].append(np.frombuffer(blob, kind, count, at))
            at += count * np.dtype(kind).itemsize
    return {n: np.concatenate(x) for n, x in found.items()}


_KEYED = (("keys", "<u4"), ("nodes", "<i8"), ("size", "<u4"))
_FIELDS = (("keys", "<u4"), ("nodes", "<i8"), ("low", "<u4"), ("high", "<u4"), ("radius", "<u2"), ("maps", "<u8"))


def _candidates(k: int, t: int, ranges: int, levels):
    """Per batch: for each range of keys its rows as columns of bytes, and what is linked here."""

    @lean
    def run(batches):
        for b in batches:
            sets = [s for s in gram_sets(b.column("text").cast(pa.binary()).to_pylist(), k) if len(s)]
            if not sets:
                continue
            rows = [mix(first_grams(s, t, levels.value)) for s in sets]
            of = np.repeat(np.arange(len(sets)), [len(r) for r in rows])
            keys, nodes = np.concatenate(rows), np.array([short_id(set_id(s)) for s in sets], np.int64)[of]
            size = np.array([len(s) for s in sets], np.int64)[of]
            maps = np.stack([bitmap(s) for s in sets])[of]
            at, balls, links = gathered(keys, nodes, Balls(size, size, np.zeros(len(size), np.int64), maps), t)
            out = [(-1 - int(x) % ranges, None, int(x), int(y)) for x, y in links]
            keys, values = keys[at], {"keys": keys[at], "nodes": nodes[at], "low": balls.low, "high": balls.high, "radius": balls.radius, "maps": balls.maps}
            out += [(*x, None) for x in packed(keys, values, ranges, _FIELDS)]
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.binary(), pa.int64(), pa.int64()))], ["part", "blob", "a", "b"])

    return run


def _meet(t: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["part"].iloc[0] < 0:
            return pdf[["a", "b"]].astype("int64")
        every = unpacked(pdf["blob"], pdf["a"].astype("int64"), _FIELDS)
        balls = Balls(*(every[n].astype(np.int64) for n in ("low", "high", "radius")), every["maps"].reshape(-1, WORDS))
        return pd.DataFrame(met(every["keys"], every["nodes"], balls, t), columns=["a", "b"], dtype="int64")

    return run


def _keyed(k: int, t: int, ranges: int, levels):
    """Per batch and range of keys: the first grams of its sets."""

    @lean
    def run(batches):
        for b in batches:
            sets = [s for s in gram_sets(b.column("text").cast(pa.binary()).to_pylist(), k) if len(s)]
            if not sets:
                continue
            rows = [mix(first_grams(s, t, levels.value)) for s in sets]
            of, keys = np.repeat(np.arange(len(sets)), [len(r) for r in rows]), np.concatenate(rows)
            values = {"keys": keys, "nodes": np.array([short_id(set_id(s)) for s in sets], np.int64)[of], "size": np.array([len(s) for s in sets], np.int64)[of]}
            cols = list(zip(*packed(keys, values, ranges, _KEYED))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int32(), pa.binary(), pa.int64()))], ["part", "blob", "n"])

    return run


def _shared(t: int):
    """Of each set the keys that another one of like size has too, a row for each set and range of keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = unpacked(pdf["blob"], pdf["n"].astype("int64"), _KEYED)
        order = np.lexsort((every["size"], every["keys"]))
        keys, nodes, size = every["keys"][order], every["nodes"][order], every["size"][order].astype(np.int64)
        # Of the rows of a key the next smaller and the next larger set are the likeliest.
        close = (keys[1:] == keys[:-1]) & (size[:-1] >= least_overlap(size[:-1], size[1:], t))
        at = np.flatnonzero(np.concatenate([close, [False]]) | np.concatenate([[False], close]))
        at = at[np.argsort(nodes[at], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(nodes[at]) != 0, [True]])).tolist() if len(at) else [0]
        out = [(int(nodes[at[i]]), keys[at[i:j]].tobytes()) for i, j in zip(cuts, cuts[1:])]
        return pd.DataFrame(out, columns=["short", "keys"]).assign(part=pdf["part"].iloc[0])[["part", "short", "keys"]]

    return run


def _mapped(k: int):
    """Per set its size and its whole bitmap."""

    @lean
    def run(batches):
        for b in batches:
            sets = [s for s in gram_sets(b.column("text").cast(pa.binary()).to_pylist(), k) if len(s)]
            cols = [pa.array([short_id(set_id(s)) for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([whole_bitmap(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["short", "size", "map"])

    return run


def _meet_again(t: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, "<u4") for x in pdf["keys"]]
        of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        maps = Maps(of, pdf["size"].to_numpy(np.int64), [np.frombuffer(x, "<u8") for x in pdf["map"]])
        return pd.DataFrame(met(np.concatenate(keys), pdf["short"].to_numpy(np.int64)[of], maps, t), columns=["a", "b"], dtype="int64")

    return run


def finer(docs: DataFrame, k: int, percent: int, size: int, levels) -> DataFrame:
    """Pairs (a, b) of short ids that connect the sets which may be similar, as whole bitmaps tell; `size` bytes of text in all.

    First grams go to ranges of keys without bitmaps; what is shared there goes on, and bitmaps go where it is, one for each set and range.
    """
    ranges = max(1, math.ceil(size / 6 * (100 - percent) / 100 / PER_FINE))
    shared = docs.mapInArrow(_keyed(k, percent, ranges, levels), "part int, blob binary, n long").groupBy("part").applyInPandas(_shared(percent), "part int, short long, keys binary")
    maps = docs.mapInArrow(_mapped(k), "short long, size long, map binary")
    return shared.join(maps, "short").groupBy("part").applyInPandas(_meet_again(percent), "a long, b long")


class Product:
    """Links among sets by the sparse product of their incidence, rows against columns.

    A column block at a time: for every gram of a row the sets that hold it are counted, and pairs
    go whose count cannot reach the bound any more with what is left of both sets. With `side` only sets of
    two sides meet, and no set its own copy there: `node` tells which are the same.
    """

    def __init__(self, sets: list[np.ndarray], t: int, side: np.ndarray | None = None, node: np.ndarray | None = None, blocks: int = 8):
        self.size, self.t, self.side, self.node = np.array([len(s) for s in sets], np.int64), t, side, np.arange(len(sets)) if node is None else node
        cols, counts = np.unique(np.concatenate(sets), return_counts=True)
        cols = cols[counts > 1]
        at = [np.searchsorted(cols, s) for s in sets]
        self.cols = [(p := x[x < len(cols)])[cols[p] == s[: len(p)]] for x, s in zip(at, sets)]
        self.cuts = np.linspace(0, len(cols), blocks + 1).astype(np.int64)
        self.many, self.held = len(cols), np.zeros(0, np.int64)

    def _index(self, others: np.ndarray) -> None:
        """By gram the places in `others` of the sets that hold it."""
        if len(others) * 2 < len(self.held) or not np.isin(others, self.held).all():
            self.held = others
            col = np.concatenate([self.cols[i] for i in others])
            row = np.repeat(others, [len(self.cols[i]) for i in others])
            order = np.argsort(col, kind="stable")
            self.rows, self.first = row[order], np.searchsorted(col[order], np.arange(self.many + 1))

    def __call__(self, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self._index(others)
        place = np.full(len(self.size), -1)
        place[others] = np.arange(len(others))
        n, m = self.size[rows][:, None], self.size[others][None, :]
        need = -(-self.t * (n + m) // (100 + self.t))
        shared = np.array([len(c) for c in self.cols])
        alive = np.minimum(shared[rows][:, None], shared[others][None, :]) >= need
        if self.side is not None:
            alive &= (self.side[rows][:, None] != self.side[others][None, :]) & (self.node[rows][:, None] != self.node[others][None, :])
        total = np.zeros(alive.shape, np.int32)
        for low, high in zip(self.cuts, self.cuts[1:]):
            ways = np.flatnonzero(alive.any(1))
            if not len(ways):
                break
            own = [self.cols[rows[r]][slice(*np.searchsorted(self.cols[rows[r]], (low, high)))] for r in ways]
            col, row = np.concatenate(own), np.repeat(ways, [len(x) for x in own])
            for c in range(0, len(col), 20_000):
                begin, count = self.first[col[c : c + 20_000]], np.diff(self.first)[col[c : c + 20_000]]
                at = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                to = place[self.rows[at]]
                flat = (np.repeat(row[c : c + 20_000], count) * len(others) + to)[to >= 0]
                total += np.bincount(flat, minlength=total.size).reshape(total.shape).astype(np.int32) if len(flat) > total.size // 50 else 0
                if len(flat) <= total.size // 50:
                    np.add.at(total.reshape(-1), flat, 1)
            more = np.minimum(np.array([len(self.cols[i]) - np.searchsorted(self.cols[i], high) for i in rows])[:, None], np.array([len(self.cols[i]) - np.searchsorted(self.cols[i], high) for i in others])[None, :])
            alive &= total + more >= need
        i, j = np.nonzero(alive & (total >= need))
        return rows[i], others[j]


def _links(k: int, t: int):
    """Spanning forest of the links among a block's sets, or between its two sides if `side` says so."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "side"])
        sets = gram_sets([x.encode() for x in pdf["text"]], k)
        node, side = pdf["node"].tolist(), pdf["side"].to_numpy()
        forest, out = Forest(), []
        for a, b in spanning(len(sets), Product(sets, t, side if side.any() else None, pd.factorize(pdf["node"])[0])):
            if node[a] != node[b] and forest.join(node[a], node[b]):
                out.append((node[a], node[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def row_key():
    """Rows that agree in doc_id and text share it: the id and 128 bits of the text."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))


def _blocks(members, size, block: int):
    return F.greatest(F.lit(1), F.ceil(members / block), F.ceil(size / BLOCK_BYTES)).cast("int")


def _labelled(docs: DataFrame, k: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_grams, node) of each document, and (node, label) of each set that has links or copies.

    A label is a struct (none, doc_id, row) of the first document by doc_id that links reach.
    """
    docs = in_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("row", row_key())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sized = docs.withColumn("bytes", F.octet_length("text").cast("long"))
    base = settled(sized.mapInArrow(_digests(k), sized.select("doc_id", "row", "bytes").schema.add("n_grams", "long").add("node", "binary").add("short", "long")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    one = settled(base.where("node is not null").groupBy("node").agg(first, F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.first("short").alias("short")))
    shared = settled(one.where("n > 1").select("node", F.col("first.row").alias("kept")))
    copies = keyed_join(base.select("node", "row"), shared, "node", "inner").where("row <> kept").select("row").distinct()
    kept = keyed_join(docs.where("text <> ''"), settled(copies), "row", "left_anti")
    ranges = max(1, math.ceil(size / 6 * (100 - percent) / 100 / PER_RANGE))
    levels = docs.sparkSession.sparkContext.broadcast(commonness(kept, k, size))  # 2 ** MOST_BITS / 2 bytes at most
    rows = kept.mapInArrow(_candidates(k, percent, ranges, levels), "part int, blob binary, a long, b long")
    some = rows.groupBy("part").applyInPandas(_meet(percent), "a long, b long").select(F.explode(F.array("a", "b")).alias("short")).distinct()
    asked = settled(one.join(some, "short", "left_semi").select(F.col("first.row").alias("row"), "bytes"))
    like = in_batches(sifted(docs, asked.select("row"), "row"))
    near = components(finer(like, k, percent, asked.agg(F.sum("bytes")).first()[0] or 0, levels)).select(F.col("node").alias("short"), F.col("label").alias("near"))
    wanted = settled(near.join(one, "short").select("near", "node", F.col("first.row").alias("row"), "bytes"))
    some = [F.min_by("node", F.xxhash64("node", F.lit(s))) for s in range(SHARED_SETS)]
    groups = wanted.groupBy("near").agg(_blocks(F.count("*"), F.sum("bytes"), block).alias("blocks"), F.array_distinct(F.array(*some)).alias("some"))
    large = settled(groups.where("blocks > 1"))
    wanted = keyed_join(wanted, large.select("near", "blocks"), "near", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    texts = settled(keyed_join(docs.select("row", "text"), dealt, "row", "inner").select("near", "node", "blocks", "block", "bytes", "text", F.lit(0).alias("side")))
    is_large = large.limit(1).count() > 0
    every = texts
    if is_large:
        pivots = keyed_join(texts.drop("block"), large.select(F.explode("some").alias("node")), "node", "inner")
        every = texts.unionByName(pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    found = settled(every.groupBy("near", "block").applyInPandas(_links(k, percent), "a binary, b binary"))
    if is_large:
        whole = texts.where("blocks > 1").dropDuplicates(["node"])
        whole = settled(whole.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")))
        sizes = whole.groupBy("near", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        main = sizes.groupBy("near").agg(F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        chunks = F.when(F.col("n") > F.col("main.n"), _blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"), block))
        more = settled(main.select("near", F.col("main.label").alias("main"), chunks.alias("chunks")).where("chunks > 0"))
        whole = keyed_join(whole.drop("side"), more, "near", "inner")
        left = whole.where("label <> main").withColumns({"chunk": F.pmod(F.xxhash64("node", F.lit(6)), "chunks").cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(1)})
        right = whole.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(0)})
        cross = left.unionByName(right).groupBy("near", "chunk", "block").applyInPandas(_links(k, percent), "a binary, b binary")
        found = settled(found.union(cross))
    names = one.select("node", "first")
    edges = found.join(names.withColumnRenamed("node", "a"), "a").select("b", F.col("first").alias("x")).join(names.withColumnRenamed("node", "b"), "b").select(F.col("x").alias("a"), F.col("first").alias("b"))
    linked = components(edges).withColumnRenamed("node", "first")
    label = one.join(linked, "first", "left").where("n > 1 or label is not null").select("node", F.coalesce("label", "first").alias("label"))
    return base, settled(label)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """doc_id, n_grams, component_id of each row: sets of k-word grams linked from `percent` similarity up.

    component_id is the smallest doc_id reachable by links, the document's own included.
    """
    base, label = _labelled(docs, k, percent, block)
    found = keyed_join(base, label, "node", "left")
    return found.select("doc_id", "n_grams", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("label.doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, block: int = 1024) -> DataFrame:
    """The first document by doc_id of each component, and all without grams; the columns stay."""
    base, label = _labelled(docs, k, percent, block)
    gone = settled(keyed_join(base.select("node", "row"), label, "node", "inner").where("row <> label.row").select(F.col("row").alias("at")).distinct())
    # A kept row that the table repeats stays once.
    again = settled(base.where("node is not null").groupBy("row").count().where("count > 1").select(F.col("row").alias("at")).join(gone, "at", "left_anti"))
    names, packed = docs.columns, docs.select(F.struct("*").alias("whole"), row_key().alias("at"))
    kept = keyed_join(packed, gone, "at", "left_anti")
    once = keyed_join(kept, again, "at", "left_anti").unionByName(keyed_join(kept, again, "at", "left_semi").dropDuplicates(["at"])) if again.limit(1).count() else kept
    return once.select(*(F.col("whole")[c].alias(c) for c in names))


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, 3, 90).withColumnRenamed("n_grams", "n_shingles")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, least) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.least FROM r JOIN e ON e.x = r.doc_id WHERE r.least < e.y)
SELECT r.doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(r.least) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
