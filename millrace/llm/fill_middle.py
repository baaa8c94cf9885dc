r"""Fill-in-middle by an Aho-Corasick event scan.

One automaton holds the ASCII characters that change a text's class (here white space, so that
words begin and end at them) and the sentinels. Its matches are a text's events. What lies between two
events is of one class, so the units in it follow from its length alone: each code point is a unit, or
the whole gap is one word. The events and the units before each are all that a rank needs to be looked up:
the last event before it, and an offset. The same scan of a formatted text finds its three sentinels,
between which the pieces stand, and so gives the text back.

Defined results: null text counts as empty and stays plain, as does a text that holds a sentinel; a null doc_id
counts as an empty one in the draw; equal rows draw alike; a very long text costs in proportion to its length
and its events, and is one row; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, lean

# The sentinels before prefix, suffix and middle, and the white space between words.
SENTINELS = ("<P>", "<S>", "<M>")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What a text is cut into: each code point, or each run of white space or of other characters.
UNITS = ("code_point", "run")


@functools.cache
def _automaton(sentinels: tuple[str, ...]):
    """White space has the value -1, a sentinel its place."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in SPACE:
        found.add_word(c, -1)
    for k, s in enumerate(sentinels):
        found.add_word(s, k)
    found.make_automaton()
    return found


class Events:
    """A text's events, as arrays: places of white space, and (place behind it, which) of each sentinel."""

    def __init__(self, text: str, sentinels: tuple[str, ...] = SENTINELS):
        every = np.fromiter((x for e in _automaton(sentinels).iter(text) for x in e), np.int64).reshape(-1, 2)
        space = every[:, 1] < 0
        self.length, self.space = len(text), every[space, 0]
        self.sentinels = [(int(at) + 1, int(k)) for at, k in every[~space]]

    @functools.cached_property
    def _gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """First place and length of what lies before, between and behind the white space."""
        first = np.concatenate(([0], self.space + 1))
        return first, np.concatenate((self.space, [self.length])) - first

    def ranks(self, unit: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of gaps and events, the units before each, and all units."""
        first, length = self._gaps
        own = np.ones(len(self.space), np.int64)
        if unit == "run":
            length = np.minimum(length, 1)
            own[1:] = np.diff(self.space) > 1  # white space behind white space goes on with its run
        units = np.empty(len(first) + len(own), np.int64)
        at = np.empty_like(units)
        units[0::2], units[1::2], at[0::2], at[1::2] = length, own, first, self.space
        before = np.cumsum(units) - units
        return at, before, int(units.sum())

    def words(self, low: int, high: int) -> int:
        """Words that begin from low to before high."""
        first, length = self._gaps
        a, b = np.searchsorted(first, (low, high))
        return int(np.count_nonzero(length[a:b]))


def looked_up(ranks: tuple[np.ndarray, np.ndarray, int], rank: int, length: int) -> int:
    """The place where the unit of that rank begins."""
    at, before, n = ranks
    if rank >= n:
        return length
    i = int(np.searchsorted(before, rank, "right")) - 1
    return int(at[i]) + rank - int(before[i])


def formatted(text: str, draws: tuple[int, int, int, int], unit: str, sentinels: tuple[str, ...], plain_percent: int, spm_percent: int) -> tuple:
    """(units, form, prefix_chars, middle_chars, middle_words, output) of a text."""
    events = Events(text, sentinels)
    ranks = events.ranks(unit)
    n = ranks[2]
    if not text or events.sentinels or draws[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, None, text
    a, b = (looked_up(ranks, r, len(text)) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    pre, suf, mid = (s + t for s, t in zip(sentinels, (text[:a], text[b:], text[a:b])))
    spm = draws[3] % 100 < spm_percent
    return n, "spm" if spm else "psm", a, b - a, events.words(a, b), suf + pre + mid if spm else pre + suf + mid


def restored_text(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> str:
    """The text that was formatted; ValueError if the output isn't of the form."""
    if form == "plain":
        return output
    order = {"psm": (0, 1, 2), "spm": (1, 0, 2)}[form]
    found = Events(output, sentinels).sentinels
    if tuple(k for _, k in found) != order or not output.startswith(sentinels[order[0]]):
        raise ValueError(f"not of the form {form}")
    ends = [at - len(sentinels[k]) for at, k in found[1:]] + [len(output)]
    piece = {k: output[at:end] for (at, k), end in zip(found, ends)}
    return piece[0] + piece[2] + piece[1]


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2 ** 32 from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_MADE = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("middle_words", pa.int64()), ("output", pa.string())]


def fill_middle(docs: DataFrame, unit: str = "code_point", sentinels: tuple[str, ...] = SENTINELS, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, middle_words (null if plain) and the output text.

    Both cuts fall on bounds of units, drawn from the id. No sentinel may hold white space or one of the others.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    if len(set(sentinels)) < 3 or any(not s or set(s) & set(SPACE) or any(s in t for t in sentinels if t != s) or any(s.endswith(t[:k]) for t in sentinels for k in range(1, len(t))) for s in sentinels):
        raise ValueError("sentinels must be free of white space, of each other and of ends that begin one")

    def run(batches):
        for b in batches:
            rows = zip(b.column("text").to_pylist(), *(b.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)))
            made = list(zip(*(formatted(t, h, unit, sentinels, plain_percent, spm_percent) for t, *h in rows))) or [()] * len(_MADE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, (_, t) in zip(made, _MADE))], ["doc_id", *(n for n, _ in _MADE)])

    asked = in_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), seed)))
    schema = asked.select("doc_id").schema
    for name, kind in _MADE:
        schema = schema.add(name, "string" if kind == pa.string() else "long")
    return asked.mapInArrow(lean(run), schema)


def restored(outputs: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """outputs (output, form and more) with `restored`, the text rebuilt from these two alone."""

    def run(batches):
        for b in batches:
            texts = [restored_text(o, f, sentinels) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
            yield b.append_column("restored", pa.array(texts, pa.string()))

    return outputs.mapInArrow(lean(run), outputs.select("*").schema.add("restored", "string"))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """The outputs of fill_middle by their digests, and those of the texts rebuilt from them."""
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return restored(fill_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "middle_words", digest("output"), digest("restored"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS r1, ('0x' || h[9:16])::BIGINT % (n + 1) AS r2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b FROM u),
p AS (SELECT *, '<P>' || substring(text, 1, a) AS pre, '<S>' || substring(text, b + 1) AS suf, '<M>' || substring(text, a + 1, b - a) AS mid FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE WHEN form <> 'plain' THEN len(regexp_extract_all(substring(' ' || text, a + 1, b - a + 1), '[\x20\x09-\x0D][^\x20\x09-\x0D]'))::BIGINT END AS middle_words,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
