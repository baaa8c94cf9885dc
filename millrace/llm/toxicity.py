"""Toxicity: a lexicon trie intersected with Levenshtein automata, and what surrounds each hit.

The lexicon is learned: stems (beginnings of words, and whole words of fewer letters) in far more toxic
training texts than clean ones that appear in varied contexts there (near copies of one text repeat
contexts, so what is theirs is no term). Terms that clean texts hardly hold are strong, the others weak. A
word is run through the trie and the automata of all its terms at once, as a set of (trie node, edits)
states; the sets are built as words need them and shared, so a word costs a look-up a letter. Only strong
terms match misspelled, and words of clean training texts that come that near one are no misspellings.

Each hit counts by its closeness and its context window. Quotation is found by pairing marks along the line
(apostrophes within words are none), and lines that begin with > are quoted whole. How much quotation and
each word near a hit speak for abuse is learned from the hits of the training rows, as log-odds that shrink
to none (for quotation to QUOTED) where there are few: words of reporting lower a hit, words of address
raise it, in whatever language the training rows have them. A logistic model of the weighted sums, fitted
to the training rows, gives the score.

Defined results: null or blank text has no hits and gets the score of that; without labelled training
rows of both kinds all scores are 0; several labels of one document count as separate rows; a very long text
is one row and its hits add up; a term of over LONGEST letters is found by its first ones; an empty
table gives an empty result; repeated rows give repeated rows; other columns are ignored by `predict`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.language_mix import held_out
from millrace.llm.shared import in_batches, lean, settled

#: Labelled training rows at most, the first by a hash of their ids.
TRAINING_ROWS = 12_000
#: Letters of a stem; the least share of toxic texts that have it, and the least likelihood ratio statistic.
SHORTEST, LONGEST, LEAST_SHARE, LEAST_G = 4, 9, 0.01, 35.0
#: From this score on a text is predicted toxic.
THRESHOLD = 0.3
#: Words, and steps of the automata, that a task remembers at most.
REMEMBERED = 100_000
#: Words on each side of a hit that its context window holds; log-odds of quotation before any is seen; hits that the log-odds of a word shrink by, hits that it must be near, and the bounds of its words' log-odds together.
WINDOW, QUOTED, SHRINK, LEAST_SEEN, LEAST_ODDS, MOST_ODDS = 6, -1.2, 10.0, 5, -2.0, 1.0

_WORD = re.compile(r"[^\W_]+")
# Quotation marks that open, with those that close them.
PAIRS = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‹": "›", "‘": "’", "‚": "‘’"}


def edits(term: str) -> int:
    """Edits that a misspelling of the term may have."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


@dataclass
class Lexicon:
    """The terms' trie with one automaton over (node, edits) states, built as words need it."""

    strong: list[str]
    weak: list[str]
    known: frozenset[str] = frozenset()

    def __post_init__(self):
        self.children, self.ends, self.allowed = [{}], {}, [0]
        self.short = {t[:-1]: t in self.strong for t in [*self.strong, *self.weak] if t.endswith(" ")}
        for t, budget in [*((t, edits(t)) for t in self.strong), *((t, 0) for t in self.weak)]:
            if t.endswith(" "):
                continue
            at = 0
            self.allowed[0] = max(self.allowed[0], budget)
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                at = self.children[at][c]
                self.allowed[at] = max(self.allowed[at], budget)
            self.ends[at] = (budget, t in self.strong)
        self._forget()

    def _forget(self) -> None:
        """Starts anew with the automaton's first state."""
        self._number, self._states, self._follow, self._exact, self._near, self._steps = {}, [], [], [], [], 0
        self._numbered(self._closed({0: 0}))

    def _numbered(self, states: tuple) -> int:
        """The number of a state set, -1 if it is empty. Notes whether a term ends there as it is (and is strong), and the fewest edits of one that ends."""
        if not states:
            return -1
        if (at := self._number.get(states)) is None:
            at = self._number[states] = len(self._states)
            ends = [(e, *self.ends[node]) for node, e in states if node in self.ends]
            exact = [strong for e, _, strong in ends if e == 0]
            self._states.append(states)
            self._follow.append({})
            self._exact.append(any(exact) if exact else None)
            self._near.append(min((e for e, budget, _ in ends if e <= budget), default=-1))
        return at

    def _closed(self, states: dict[int, int]) -> tuple:
        """States with letters of a term left out of the word; the fewest edits of each node."""
        todo = list(states.items())
        while todo:
            node, e = todo.pop()
            for to in self.children[node].values():
                if e + 1 <= self.allowed[to] and e + 1 < states.get(to, 99):
                    states[to] = e + 1
                    todo.append((to, e + 1))
        return tuple(sorted(states.items()))

    def step(self, states: tuple, c: str) -> tuple:
        out: dict[int, int] = {}
        for node, e in states:
            if e + 1 <= self.allowed[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1  # a letter too many
            for letter, to in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.allowed[to] and cost < out.get(to, 99):
                    out[to] = cost
        return self._closed(out)

    def match(self, word: str) -> tuple[int, bool]:
        """Edits to the nearest term, -1 if none is near enough, and whether it is strong.

        A term without edits may go on (it is a stem); with edits it must end where the word does.
        """
        if self._steps > REMEMBERED:
            self._forget()
        at, follow, exact, stem = 0, self._follow, self._exact, None
        for c in word:
            if (to := follow[at].get(c)) is None:
                to = follow[at][c] = self._numbered(self.step(self._states[at], c))
                self._steps += 1
            if to < 0:
                break
            at = to
            if exact[at] is not None:
                stem = bool(stem) or exact[at]
        else:
            if stem is None and self._near[at] >= 0:
                return self._near[at], True
        return (-1, False) if stem is None else (0, stem)

    def is_hit(self, word: str) -> tuple[float, str]:
        """Closeness of a word, and `strong`, `near` (misspelled) or `weak`."""
        d, strong = (0, self.short[word]) if word in self.short else self.match(word)
        if d == 0:
            return 1.0, "strong" if strong else "weak"
        return (0.0, "") if d < 0 or word in self.known else (0.7 / d, "near")


def quotations(line: str) -> list[tuple[int, int]]:
    """Stretches of a line between paired marks, the marks included; all of it behind a leading >."""
    if line.lstrip().startswith(">"):
        return [(0, len(line))]
    out, at = [], 0
    letter = lambda i: 0 <= i < len(line) and line[i].isalnum()
    while at < len(line):
        c = line[at]
        if c in PAIRS and not (letter(at - 1) and letter(at + 1)) and not (c in "'’‘" and letter(at - 1)):
            end = next((i for i in range(at + 1, len(line)) if line[i] in PAIRS[c] and not (letter(i - 1) and letter(i + 1))), -1)
            if end > 0:
                out.append((at, end + 1))
                at = end
        at += 1
    return out


def contexts(text: str, words: list[re.Match], at: list[int]) -> list[tuple[bool, frozenset[str]]]:
    """For each of the words at these places whether it is quoted, and the words near it on its line."""
    out, begin, end, spans = [], 0, -1, []
    for i in at:
        m = words[i]
        if m.start() > end:
            begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
            end = len(text) if end < 0 else end
            spans = quotations(text[begin:end])
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        out.append((any(a < m.end() - begin and m.start() - begin < b for a, b in spans), frozenset(w.group() for w in near if begin <= w.start() < end)))
    return out


def context_weight(quoted: bool, near: frozenset[str], odds: dict[str, float]) -> float:
    """How much a hit counts by its window: 1 where nothing speaks for or against abuse."""
    c = min(max(sum(odds.get(w, 0.0) for w in sorted(near)), LEAST_ODDS), MOST_ODDS) + (odds.get("", QUOTED) if quoted else 0.0)
    return 2 / (1 + math.exp(-c))


def hits_of(text: str, lexicon: Lexicon, seen: dict) -> tuple[list[tuple[str, float, bool, frozenset[str]]], int]:
    """Kind, closeness and context of each hit, and the number of words."""
    text = text.lower()
    hits, every = {}, _WORD.findall(text)
    for w in set(every):
        if (c := seen.get(w)) is None:
            if len(seen) > REMEMBERED:
                seen.clear()
            c = seen[w] = lexicon.is_hit(w)
        if c[0]:
            hits[w] = c
    if not hits:
        return [], len(every)
    words = list(_WORD.finditer(text))
    at = [i for i, m in enumerate(words) if m.group() in hits]
    return [(hits[words[i].group()][1], hits[words[i].group()][0], *c) for i, c in zip(at, contexts(text, words, at))], len(every)


def features(text: str, lexicon: Lexicon, odds: dict[str, float], seen: dict) -> tuple[float, float, float, int, int]:
    """Summed weights of strong, misspelled and weak hits, the number of hits and that of words."""
    found, words = hits_of(text, lexicon, seen)
    sums = {"strong": 0.0, "near": 0.0, "weak": 0.0}
    for kind, close, quoted, near in found:
        sums[kind] += close * context_weight(quoted, near, odds)
    return sums["strong"], sums["near"], sums["weak"], len(found), words


def columns(found: list[tuple]) -> np.ndarray:
    """What the logistic model sees of each text's features."""
    strong, near, weak, _, words = np.array(found, float).reshape(-1, 5).T
    many = np.log1p(words / 50)
    return np.stack([np.ones(len(strong)), np.log1p(4 * strong), np.log1p(4 * near), np.log1p(weak), np.minimum(weak, 8.0), np.log1p(100 * weak / (words + 20)), many * (weak > 0)], 1)


def stems(words: list[str], wanted: frozenset[str] | None = None) -> dict[str, float]:
    """How much a text holds of each stem (of the wanted ones), by the logarithm of its count.

    A word of fewer letters ends with a space, as it is a term as a whole only.
    """
    every: dict[str, int] = defaultdict(int)
    for w, k in Counter(words).items():
        for s in (w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1)) if len(w) >= SHORTEST else (w + " ",):
            if wanted is None or s in wanted:
                every[s] += k
    return {s: math.log2(1 + n) for s, n in every.items()}


def _toxic_stems(frames):
    """Per stem of a task's toxic rows: how much they hold, rows, and digests of what stands before it."""
    held, rows, before = Counter(), Counter(), defaultdict(set)
    for pdf in frames:
        for text in pdf["text"]:
            words = _WORD.findall(text.lower())
            own = stems(words)
            held.update(own)
            rows.update(own.keys())
            for a, b in set(zip(["", *words], words)):
                for s in stems([b]):
                    before[s].add(zlib.crc32(a.encode()) & 0xFFFFF)
    if held:
        names = sorted(held)
        yield pd.DataFrame({"stem": names, "toxic": [held[s] for s in names], "n_rows": [rows[s] for s in names], "before": [list(before[s]) for s in names]})


def _clean_stems(wanted: frozenset[str]):
    def run(frames):
        count = Counter()
        for pdf in frames:
            for text in pdf["text"]:
                count.update(stems(_WORD.findall(text.lower()), wanted))
        if count:
            yield pd.DataFrame({"stem": list(count), "clean": list(count.values())})

    return run


def _most_held(frames):
    """What stems could hold of a task's rows at most."""
    yield pd.DataFrame({"most": [sum(math.log2(1 + len(_WORD.findall(t.lower()))) for pdf in frames for t in pdf["text"])]})


def _near_words(lexicon: Lexicon):
    def run(frames):
        found = set()
        for pdf in frames:
            for text in pdf["text"]:
                found |= {w for w in set(_WORD.findall(text.lower())) if lexicon.match(w)[0] > 0}
        yield pd.DataFrame({"word": sorted(found)}, dtype=str)

    return run


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text and toxic of labelled documents that aren't held out; at most `rows`."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    picked = settled(known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    return settled(in_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def likelihood_ratio(a, n, b, m):
    """The G statistic of a in n against b in m."""
    p = (a + b) / (n + m)
    term = lambda k, of: k * np.log(np.maximum(k, 1e-9) / (of * p)) + (of - k) * np.log(np.maximum(of - k, 1e-9) / (of * (1 - p) + 1e-9))
    return 2 * (term(a, n) + term(b, m))


def learn_terms(rows: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Strong terms, weak terms, and clean words that come near a strong one."""
    toxic, clean = rows.where(F.col("toxic") == 1), rows.where(F.col("toxic") != 1)
    of = lambda rows: rows.mapInPandas(_most_held, "most double").agg(F.sum("most")).first()[0] or 0.0
    n, m, least = of(toxic), of(clean), max(3, math.ceil(toxic.count() * LEAST_SHARE))
    if not n or not m:
        return [], [], []
    parts = toxic.mapInPandas(_toxic_stems, "stem string, toxic double, n_rows long, before array<int>").groupBy("stem")
    sums = parts.agg(F.sum("toxic").alias("toxic"), F.sum("n_rows").alias("n_rows"), F.size(F.array_distinct(F.flatten(F.collect_list("before")))).alias("before"))
    # Stems of a share of all toxic rows: at most 1 / LEAST_SHARE times the stems of a text.
    found = sums.where((F.col("n_rows") >= least) & (F.col("before") >= F.col("toxic") * 0.5)).toPandas()
    counts = clean.mapInPandas(_clean_stems(frozenset(found["stem"])), "stem string, clean double").groupBy("stem").agg(F.sum("clean").alias("clean")).toPandas()
    found = found.merge(counts, on="stem", how="left").fillna({"clean": 0})
    odds = (found["toxic"] + 0.5) / (n + 1) / ((found["clean"] + 0.5) / (m + 1))
    found = found.assign(odds=odds, g=likelihood_ratio(found["toxic"].to_numpy(float), n, found["clean"].to_numpy(float), m), letters=found["stem"].str.len())
    found = found[(found["odds"] >= 8) & (found["g"] >= LEAST_G)].sort_values(["g", "letters", "stem"], ascending=[False, False, True])
    # Of stems that continue each other the likeliest stands for all; of equals the longest, the whole word.
    strong, weak, begun, taken = [], [], set(), set()
    for r in found.itertuples():
        parts = {r.stem[:i] for i in range(1, len(r.stem) + 1)}
        if r.stem not in begun and not parts & taken:
            (strong if r.clean <= 0.001 * m and r.odds >= 40 else weak).append(r.stem)
            taken.add(r.stem)
            begun |= parts
    lexicon = Lexicon(strong, [])
    known = clean.mapInPandas(_near_words(lexicon), "word string").distinct().collect() if strong else []
    return sorted(strong), sorted(weak), sorted(r.word for r in known)


def _hit_contexts(lexicon: Lexicon):
    """Per word near hits of a task's rows ('' for quotation): hits, and hits of toxic rows; all hits under a space."""

    def run(frames):
        every, toxic, seen = Counter(), Counter(), {}
        for pdf in frames:
            for text, label in zip(pdf["text"], pdf["toxic"]):
                for _, _, quoted, near in hits_of(text, lexicon, seen)[0]:
                    names = {" ", *near, *([""] if quoted else [])}
                    every.update(names)
                    toxic.update(names if label == 1 else ())
        yield pd.DataFrame({"word": list(every), "n": list(every.values()), "toxic": [toxic[w] for w in every]}).astype({"word": str, "n": "int64", "toxic": "int64"})

    return run


def context_odds(n: int, toxic: int, rate: float) -> float:
    """Log-odds that hits in a context are abuse, against all hits' rate."""
    logit = lambda p: math.log(p / (1 - p))
    held = lambda p: min(max(p, 0.01), 0.99)
    return logit(held((toxic + SHRINK * rate) / (n + SHRINK))) - logit(held(rate))


def learn_contexts(rows: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """Log-odds of the words near hits and ('') of quotation; at most 2 * WINDOW words a hit of the training rows."""
    table = rows.mapInPandas(_hit_contexts(lexicon), "word string, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    found = {r["word"]: (r["n"], r["toxic"]) for r in table.collect()}
    n, toxic = found.pop(" ", (0, 0))
    rate = (toxic + 1) / (n + 2)
    quoted = found.pop("", (0, 0))
    odds = {w: o for w, (k, t) in found.items() if k >= LEAST_SEEN and abs(o := context_odds(k, t, rate)) >= 0.2}
    return odds | {"": (quoted[0] * context_odds(*quoted, rate) + SHRINK * QUOTED) / (quoted[0] + SHRINK)}


def _features(lexicon: Lexicon, odds: dict[str, float]):
    def run(frames):
        seen: dict = {}
        for pdf in frames:
            found = [features(t, lexicon, odds, seen) for t in pdf["text"]]
            yield pd.DataFrame(found, columns=["strong", "near", "weak", "hits", "words"]).assign(toxic=pdf["toxic"].to_numpy())

    return run


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of the columns by regularised Newton steps.

    The weight of misspelled hits is pulled towards a share of that of exact ones: training rows may show few.
    """
    prior = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], 0.3)
    prior[:3], pull[:3] = (0.0, 2.0, 2.0), (1e-6, 0.05, 5.0)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        w -= np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), grad), -2, 2)
    return w


@dataclass
class Model:
    strong: list[str]
    weak: list[str]
    known: list[str]
    odds: dict[str, float]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    picked = training_rows(docs, labels, rows)
    strong, weak, known = learn_terms(picked)
    lexicon = Lexicon(strong, weak, frozenset(known))
    # At most `rows` rows of five numbers.
    kinds = "strong double, near double, weak double, hits long, words long, toxic int"
    odds = learn_contexts(picked, lexicon)
    table = picked.mapInPandas(_features(lexicon, odds), kinds).toPandas()
    x, y = columns(table[["strong", "near", "weak", "hits", "words"]].to_numpy()), (table["toxic"] == 1).to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model([], [], [], {}, [30.0 if len(y) and y.all() else -30.0, *[0.0] * (x.shape[1] - 1)])
    return Model(strong, weak, known, odds, fit(x, y).tolist())


def _scored(model: Model):
    @lean
    def run(batches):
        lexicon, seen, weights = Lexicon(model.strong, model.weak, frozenset(model.known)), {}, np.array(model.weights)
        for batch in batches:
            found = [features(t or "", lexicon, model.odds, seen) for t in batch.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(columns(found) @ weights, -30, 30)))
            at = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(batch.columns) if i != at), pa.array(score, pa.float64()), pa.array([x[3] for x in found], pa.int64())], [*(n for n in batch.schema.names if n != "text"), "score", "n_hits"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of hits of each row."""
    rows = in_batches(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))
    schema = rows.select("doc_id", "held_out").schema.add("score", "double").add("n_hits", "long")
    return rows.mapInArrow(_scored(model), schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels)).select("doc_id", "held_out", "score", "predicted", "n_hits")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic; the columns stay."""
    model = train(docs, labels)
    packed = in_batches(docs.select("text", F.struct(*docs.columns).alias("whole")))
    schema = packed.select("whole").schema.add("score", "double").add("n_hits", "long")
    return packed.mapInArrow(_scored(model), schema).where(F.col("score") < THRESHOLD).select("whole.*")
