"""Language ID by multilingual mixture inference.

Character trigrams of labelled training documents give each language a smoothed model. A document's
words get a log-likelihood under every model, and expectation-maximisation estimates the proportions
of the languages that its words come from. The set of languages is the one of the highest
likelihood less a penalty for each language beyond the first; the prediction is the largest share.
The log-likelihood of shares is concave, so its slopes at a point bound what any mixture can add: a text
whose best single language no mixture can beat by the penalty is settled without another round.

Defined results: null text, and text without a letter, is `und` with score 0; without any training
document every text is `und`; more than MOST_LANGUAGES learned languages are an error; a document longer than a batch is scored whole; an empty table gives an
empty result; repeated rows give repeated rows; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, keyed_join, settled, slices

#: Training documents for each language at most, the first by a hash of their ids; languages that a model may have.
PER_LANGUAGE, MOST_LANGUAGES = 2_000, 2_000
#: Likelihoods (trigrams by languages) that a task holds at once, about.
CELLS = 4_000_000
#: Trigram buckets, additive smoothing, rounds of expectation-maximisation, log-likelihood that another language has to add for each log of the words.
BUCKETS, SMOOTH, ROUNDS, PENALTY = 1 << 15, 0.2, 12, 3.0


def held_out(doc_id):
    """crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _lower() -> np.ndarray:
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams within words (runs of letters, with an edge each side), where each word's begin, and each word's text."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    points = np.where(letter, _lower()[points], 32)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    centre = np.flatnonzero(letter)
    if not len(centre):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = points[centre - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + points[centre] * np.uint64(0xBF58476D1CE4E5B9) + points[centre + 1] * np.uint64(0x94D049BB133111EB)
    buckets = ((h ^ (h >> np.uint64(31))) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - 15)).astype(np.int64)
    starts = np.flatnonzero(~letter[centre - 1])
    return buckets, starts, np.searchsorted(first, centre[starts], side="right") - 1


def _counts(frames):
    """Counts of trigram buckets per language in a task's rows."""
    sums: dict[str, np.ndarray] = {}
    for pdf in frames:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            buckets = words_of([text])[0]
            sums[lang] = sums.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at].astype(np.int64)})


def sampled_ids(known: DataFrame, per_language: int) -> tuple[DataFrame, DataFrame]:
    """(sampled, lang): of each language the `per_language` first ids by hash; and (lang), the languages that are learned.

    Only ids whose hash is under a bound are ranked. The bound leaves each language twice as many as asked, by
    its count; where repeated ids make that too few, it grows until there are enough or all are ranked.
    """
    hashed = known.select("doc_id", "lang", ((F.xxhash64("doc_id", F.lit(5)) / 2.0**64) + 0.5).alias("h"))
    counts = hashed.groupBy("lang").agg(F.count("*").alias("n"))
    counts = settled(counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES))
    times = 2
    while True:
        limit = F.broadcast(counts.select("lang", (F.lit(float(times * per_language + 100)) / F.col("n")).alias("limit")))  # MOST_LANGUAGES rows at most
        few = settled(hashed.join(limit, "lang").where("h < limit").select("lang", "h", "doc_id"))
        found = few.groupBy("lang").count().join(counts, "lang", "right")
        if not found.where((F.coalesce("count", F.lit(0)) < per_language) & (F.coalesce("count", F.lit(0)) < F.col("n"))).limit(1).count():
            break
        times *= 16
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ranked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language)
    return settled(ranked.select(F.col("doc_id").alias("sampled"), "lang").distinct()), counts.select("lang")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each bucket under each; from a bounded sample of labelled rows."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids, kept = sampled_ids(known, per_language)
    sample = keyed_join(known.select(F.col("doc_id").alias("sampled"), "text", "lang").join(F.broadcast(kept), "lang", "left_semi"), ids.select("sampled").distinct(), "sampled", "left_semi")
    # At most MOST_LANGUAGES x BUCKETS rows.
    table = sample.select("lang", "text").mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    # By bucket in memory, as words look it up.
    logs = np.empty((len(langs), BUCKETS), np.float32, order="F")
    for lang, own in table.groupby("lang"):
        counts = np.full(BUCKETS, SMOOTH)
        counts[own["bucket"]] += own["n"]
        logs[langs.index(lang)] = np.log(counts / counts.sum())
    return langs, logs


def mixtures(blocks, doc: np.ndarray, n: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the allowed languages (n documents by languages), log-likelihoods, and what any mixture adds to these at most.

    blocks() gives ranges of words with their likelihoods.
    """
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    langs = allowed.shape[1]
    by_doc = lambda own, x: np.stack([np.bincount(own, x[:, k], n) for k in range(langs)], 1)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        sums = np.zeros((n, langs))
        for i, j, like in blocks():
            part = share[doc[i:j]] * like
            part /= part.sum(1, keepdims=True)
            sums += by_doc(doc[i:j], part)
        share = sums / words[:, None]
    fit, slope = np.zeros(n), np.zeros((n, langs))
    for i, j, like in blocks():
        mixed = np.maximum((share[doc[i:j]] * like).sum(1), 1e-300)
        fit += np.bincount(doc[i:j], np.log(mixed), n)
        slope += by_doc(doc[i:j], like / mixed[:, None])
    return share, fit, slope.max(1) - words


def word_blocks(buckets: np.ndarray, starts: np.ndarray, table: np.ndarray):
    """A function that goes through (from, to, log-likelihoods by language) of blocks of words; one block is worked out once."""
    by_bucket, ends = np.ascontiguousarray(table.T), np.append(starts[1:], len(buckets))
    most, cuts = max(1, CELLS // table.shape[0]), [0]
    while cuts[-1] < len(starts):
        at = cuts[-1]
        cuts.append(max(at + 1, int(np.searchsorted(ends, starts[at] + most, "right"))))
    made = lambda i, j: np.add.reduceat(by_bucket[buckets[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0, dtype=np.float64)
    every = list(zip(cuts, cuts[1:]))
    held = [(i, j, made(i, j)) for i, j in every] if len(every) == 1 else None
    return lambda: held or ((i, j, made(i, j)) for i, j in every)


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (-1 without a letter), its share, and how many languages the chosen set has."""
    n, langs = len(texts), table.shape[0]
    best, score, many = np.full(n, -1), np.zeros(n), np.zeros(n, int)
    buckets, starts, doc = words_of(texts)
    if not len(starts):
        return best, score, many
    logs = word_blocks(buckets, starts, table)
    by_doc = lambda own, x: np.stack([np.bincount(own, x[:, k], n) for k in range(langs)], 1)
    words = np.bincount(doc, minlength=n)
    single = sum(by_doc(doc[i:j], log) for i, j, log in logs())
    first, worth = single.argmax(1), single.max(1)
    best[words > 0], score[words > 0], many[words > 0] = first[words > 0], 1.0, 1
    penalty = PENALTY * np.log(np.maximum(words, 2))
    slack = 1e-6 * (1 + np.abs(worth))
    open_ = np.zeros(n, bool)
    if langs > 1:
        # Against the best single language: the steepest slope there bounds the gain of all mixtures.
        ratio = lambda own, log: np.exp(np.minimum(log - log[np.arange(len(own)), first[own]][:, None], 60))
        gain = sum(by_doc(doc[i:j], ratio(doc[i:j], log)) for i, j, log in logs()).max(1) - words
        open_ = (words > 1) & (gain >= penalty - slack)
    size, order = 1, None
    while open_.any() and size <= langs:
        at = np.flatnonzero(open_)
        name = np.full(n, -1)
        name[at] = np.arange(len(at))
        mine = open_[doc]
        own, base, place = name[doc[mine]], np.zeros(len(at)), np.concatenate([[0], np.cumsum(mine)])
        for i, j, log in logs():
            base += np.bincount(name[doc[i:j]][mine[i:j]], log[mine[i:j]].max(1), len(at))

        def likes():
            for i, j, log in logs():
                kept = log[mine[i:j]]  # noqa: B023
                if len(kept):
                    yield place[i], place[j], np.exp(np.maximum(kept - kept.max(1)[:, None], -60))  # noqa: B023

        one = list(likes()) if isinstance(logs(), list) else None
        allowed = np.zeros((len(at), langs))
        if order is None:
            allowed[:] = 1
        else:
            np.put_along_axis(allowed, order[at][:, :size], 1, 1)
        share, fit, more = mixtures((lambda: one) if one else likes, own, len(at), allowed)  # noqa: B023
        if order is None:
            # All languages first: their shares give the nested sets, their slopes the most that any set can reach.
            order = np.zeros((n, langs), int)
            order[at] = np.argsort(-share, axis=1, kind="stable")
            most = np.full(n, -np.inf)
            most[at] = fit + base + more
        else:
            gained = fit + base - penalty[at] * (size - 1)
            better = gained > worth[at]
            now = at[better]
            worth[now], many[now] = gained[better], size
            best[now], score[now] = share[better].argmax(1), np.clip(share[better].max(1), 0, 1)
        size += 1
        open_ &= most - penalty * (size - 1) >= worth - slack
    return best, score, many


def _predict(model):
    def run(batches):
        langs, table = model.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            preds, scores, many = [], [], []
            # Documents are by languages too in memory, a few numbers each.
            most = max(64, CELLS // 4 // max(1, len(langs)))
            for i, j in ((a, min(a + most, j)) for i, j in slices(texts, 400_000) for a in range(i, j, most)):
                if langs:
                    best, score, k = infer(texts[i:j], table)
                else:
                    best, score, k = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i, int)
                preds += [langs[x] if x >= 0 else "und" for x in best]
                scores += score.tolist()
                many += k.tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(many, pa.int32())], ["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    return run


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the number of languages found in each row."""
    # The model is languages x BUCKETS floats, MOST_LANGUAGES x BUCKETS at most.
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    schema = rows.select("doc_id", "held_out").schema
    return rows.mapInArrow(_predict(model), schema.add("lang_pred", "string").add("score", "double").add("n_langs", "integer"))


def language_mix(docs: DataFrame) -> DataFrame:
    docs = in_batches(docs.select("doc_id", "text", "lang"))
    return predict(docs, *train(docs))
