"""Byte-level BPE: overlapping chunk encoding and decoding.

A text over `chunk` characters is dealt as overlapping chunks to all tasks, and each is split into
pre-tokens by itself. A chunk but the first may begin inside a pre-token, but once its boundaries
meet the previous chunk's, they agree from there on, as a match depends only on what follows its
start. The chunks are cut at such a boundary and their pieces encoded in parallel. Where no boundary
is shared (one pre-token longer than the overlap), the two chunks are split again as one text.

Defined results: null text counts as empty and has no tokens; repeated rows give repeated rows; a very
long text costs in proportion to its length, and its ids meet in one row; an empty table gives an empty
result; columns besides doc_id and text are ignored by `encode`.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, lean

#: Pieces whose tokens a task remembers at most.
REMEMBERED = 100_000


@functools.cache
def _splitter(pattern: str):
    import regex

    # The white space that the pattern means is Unicode's property.
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Pieces(dict):
    """Tokens of a piece as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in self.ranks.items()}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = np.array(self.core.encode_ordinary(piece), "<u4").tobytes()
        return out


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str, pattern: str):
    @lean
    def run(batches):
        tokens, split = _pieces(path), _splitter(pattern).findall
        for b in batches:
            ids = [b"".join([tokens[p] for p in split(t)]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _boundaries(pattern: str):
    def run(frames):
        find = _splitter(pattern).finditer
        for pdf in frames:
            yield pdf.assign(ends=[[m.end() for m in find(t)] for t in pdf["text"]])

    return run


def stitch(texts: list[str], ends: list, step: int, pattern: str, margin: int = 4) -> list[tuple[str, list[int]]]:
    """The chunks' texts cut at shared boundaries, with the ends of the pre-tokens in each.

    texts[i] starts at i * step. A chunk's ends within `margin` of its own end aren't trusted, as a match
    there may depend on what follows; the last chunk's are.
    """
    find = _splitter(pattern).finditer
    out, begin = [], 0  # begin: where the next piece starts, a true boundary
    text, own, at = texts[0], np.asarray(ends[0], np.int64), 0
    for i in range(1, len(texts)):
        nxt, start = np.asarray(ends[i], np.int64) + i * step, i * step
        sure = own[own <= at + len(text) - margin]
        shared = np.intersect1d(sure[sure > max(begin, start)], nxt)
        # White space before a boundary may be split by what follows it; the next chunk saw the same text from there.
        if len(shared):
            cut = int(shared[0])
            out.append((text[begin - at : cut - at], (own[(own > begin) & (own <= cut)] - begin).tolist()))
            begin, text, own, at = cut, texts[i], nxt[nxt > cut], start
        else:
            text = text[begin - at :] + texts[i][at + len(text) - start :]
            at = begin
            own = np.array([m.end() for m in find(text)], np.int64) + at
    out.append((text[begin - at :], (own[own > begin] - begin).tolist()))
    return out


def _stitched(step: int, pattern: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").drop_duplicates("i")
        parts = stitch(pdf["text"].tolist(), pdf["ends"].tolist(), step, pattern)
        return pd.DataFrame({"row": pdf["row"].iloc[0], "i": range(len(parts)), "text": [p[0] for p in parts], "ends": [p[1] for p in parts]})

    return run


def _encode_cut(path: str):
    def run(frames):
        tokens = _pieces(path)
        for pdf in frames:
            ids = [b"".join([tokens[t[a:b]] for a, b in zip([0, *e], e)]) for t, e in zip(pdf["text"], (list(x) for x in pdf["ends"]))]
            yield pd.DataFrame({"row": pdf["row"], "i": pdf["i"], "ids": ids})

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """doc_id and ids of each row, as little-endian unsigned 32-bit integers."""
    docs = in_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    schema = docs.select("doc_id").schema.add("ids", "binary")
    short = docs.where(F.length("text") <= chunk).mapInArrow(_encode(path, pattern), schema)
    return short.union(_encode_long(docs, path, pattern, chunk, overlap))


def _encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id and ids of the texts over a chunk."""
    step = chunk - overlap
    long = docs.where(F.length("text") > chunk).withColumn("row", F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text")))
    # The text is cut once, and each piece gets the begin of the next; a last piece within an overlap is no chunk.
    count = F.ceil((F.length("text") - overlap) / step).cast("int")
    cut = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % step), F.lit(0))), lambda own: F.transform(own, lambda x, i: F.concat(x, F.left(F.coalesce(F.get(own, i + 1), F.lit("")), F.lit(overlap))))), F.lit(0))
    chunks = long.select("row", F.posexplode(F.slice(cut, F.lit(1), count)).alias("i", "text")).repartition("row", "i")
    bounds = chunks.mapInPandas(_boundaries(pattern), "row string, i int, text string, ends array<int>")
    cut = bounds.groupBy("row").applyInPandas(_stitched(step, pattern), "row string, i int, text string, ends array<int>")
    coded = cut.repartition("row", "i").mapInPandas(_encode_cut(path), "row string, i int, ids binary")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])
    whole = coded.groupBy("row").agg(F.unhex(F.array_join(F.transform(parts, F.hex), "")).alias("ids"))
    return long.select("doc_id", "row").join(whole, "row").select("doc_id", "ids")


def _decode(path: str):
    @lean
    def run(batches):
        bytes_of = _pieces(path).bytes_of.__getitem__
        for b in batches:
            text = [b"".join(map(bytes_of, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for."""
    coded = in_batches(coded).select("doc_id", "ids")
    return coded.mapInArrow(_decode(path), coded.select("doc_id", "ids").schema.add("decoded", "binary"))


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """What `decode` makes of `encode`; a text of one chunk takes both steps in one Python worker, so that no task holds two."""
    docs = in_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    schema = docs.select("doc_id").schema.add("ids", "binary").add("decoded", "binary")
    there, back = _encode(path, pattern), _decode(path)
    short = docs.where(F.length("text") <= chunk).mapInArrow(lambda batches: back(there(batches)), schema)
    return short.union(decode(_encode_long(docs, path, pattern, chunk, overlap), path))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_chunks(docs: DataFrame) -> DataFrame:
    path, pattern = vocabulary()
    both = decode(encode(docs, path, pattern), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
