"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: an AND of runs, each an OR of
strings, each an AND of its rarest trigrams (any of a string's trigrams are mandatory for it). The index
holds the posting lists of the trigrams that queries name, in blocks of documents, so that no list
outgrows a task; within each block the lists are intersected and united as the queries say, and only the
documents left are verified by the regexes. A rule without mandatory trigrams scans every text.

Defined results: null text counts as empty; spans count code points, end exclusive; a key block ends with its
END line, if that is what the next five dashes begin; one without (cut short) with the last character that a
key's body can hold, behind any header lines: base64 and signs of escaped, quoted or wrapped lines; a very long text costs in proportion to
its length and the logarithm of its spans; repeated rows give repeated result rows; an empty table gives an
empty result; columns besides doc_id and text are ignored by `scan`, kept by `redact`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import settled, spread

#: Documents in a block of the index, about; trigrams that each string is looked for by; strings that a run may stand for.
BLOCK_DOCS, TRIGRAMS_EACH, MOST_STRINGS = 50_000, 2, 16
#: Characters of the pieces that a text is cut into once, before spans are cut out of it.
PIECE = 1_024


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Matches whose `group` is shorter are dropped after matching.
    group: int = 0
    least: int = 0
    any_case: bool = False
    base: bool = True

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex

    @property
    def sql(self) -> str:
        """Without possessive repeats, which only spare Java its stack: what follows them never needs a part of theirs."""
        return self.regex.replace("*+", "*")


# The base rules of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# The marks of private keys, the header lines inside, and what a body can hold besides.
_KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_HEADER = r"(?:Version|Comment|MessageID|Hash|Charset|Proc-Type|DEK-Info):[^\x0A\x0D\\]*"
_BREAK = r"(?:[\x0A\x0D]|\\[nr])[\x20\x09\x0A\x0D>]*"
PEM = rf"-----BEGIN {_KEY}(?:(?:-{{0,4}}[^-])*+-----+END {_KEY}|(?:{_BREAK}{_HEADER})*+[A-Za-z0-9+/=:,>\"'\\\x20\x09-\x0D-]*)"
#: What the method adds: rules whose trigram queries are selective.
ADDED = (
    Rule("pem", PEM, base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", base=False),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
)
RULES = BASE + ADDED


# ---- from a regex to its trigram query. A parsed regex is a list of (set of characters or None, or a list of such lists, least, most).


def parsed(regex: str) -> list[list]:
    """The alternatives of a regex: literals, classes, groups, alternatives and the usual quantifiers.

    ValueError for anything else, so that no rule is searched by a query that misreads it.
    """
    at = 0

    def fail(why: str):
        raise ValueError(f"{why} at {at} of {regex}")

    def character() -> str | None:
        """One escaped or plain character; None if it stands for a class."""
        nonlocal at
        c = regex[at]
        at += 1
        if c != "\\":
            return c
        c = regex[at : at + 1]
        at += 1
        if c == "x":
            at += 2
            return chr(int(regex[at - 2 : at], 16))
        if c in ("s", "S", "d", "D", "w", "W"):
            return None
        return c if c and not c.isalnum() else fail("an unknown escape")

    def bracket() -> set[str] | None:
        """The characters of a class, None for a negated or named one."""
        nonlocal at
        negated = regex.startswith("^", at)
        at += negated
        out, whole = set(), not negated
        while at < len(regex) and regex[at] != "]":
            c = character()
            if c is not None and regex.startswith("-", at) and regex[at + 1 : at + 2] not in ("]", ""):
                at += 1
                last = character()
                out |= {chr(x) for x in range(ord(c), ord(last) + 1)}
            elif c is None:
                whole = False
            else:
                out.add(c)
        at += 1
        return out if whole else None

    def atom():
        nonlocal at
        c = regex[at]
        if c == "(":
            at += 3 if regex.startswith("(?:", at) else 1
            if regex.startswith("?", at):
                fail("an unknown group")
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            at += 1
            return bracket()
        if c == ".":
            at += 1
            return None
        if c in "^$*+?{":
            fail("an unknown sign")
        c = character()
        return None if c is None else {c}

    def times() -> tuple[int, float]:
        nonlocal at
        c = regex[at : at + 1]
        out = {"*": (0, math.inf), "+": (1, math.inf), "?": (0, 1)}.get(c, (1, 1))
        if c == "{":
            end = regex.index("}", at)
            low, comma, high = regex[at + 1 : end].partition(",")
            out, at = (int(low), int(high) if high else math.inf if comma else int(low)), end
        if c and c in "*+?{":
            at += 1
            if regex[at : at + 1] in ("?", "+") and regex[at : at + 1]:
                at += 1
        return out

    def alternatives() -> list[list]:
        nonlocal at
        out: list[list] = [[]]
        while at < len(regex) and regex[at] != ")":
            if regex[at] == "|":
                at += 1
                out.append([])
                continue
            one = atom()
            out[-1].append((one, *times()))
        return out

    done = alternatives()
    return done if at == len(regex) else fail("an unmatched bracket")


def strings(node, low: int, high: float) -> list[str] | None:
    """The few strings that a repeated node stands for, in lower case, or None."""
    if node is None or high > 3:
        return None
    one = sorted({c.lower() for c in node}) if isinstance(node, set) else [x for alt in node for x in (joined(alt) or [None])]
    if None in one or sum(len(one) ** k for k in range(low, int(high) + 1)) > MOST_STRINGS:
        return None
    return ["".join(p) for k in range(low, int(high) + 1) for p in product(one, repeat=k)]


def joined(nodes: list) -> list[str] | None:
    out = [""]
    for node in nodes:
        one = strings(*node)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in one]
    return out


# Letters from common to rare in running text; all other characters count as rarer.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"


def rarest(text: str, chosen: set[str]) -> frozenset[str]:
    """The trigrams that a string is looked for by: rare letters first, those that other strings use anyway before all."""
    every = {text[i : i + 3] for i in range(len(text) - 2)}
    rank = lambda g: (g not in chosen, -sum(COMMON.find(c) if c in COMMON else 30 for c in g), g)
    return frozenset(sorted(every, key=rank)[:TRIGRAMS_EACH])


def trigram_query(regex: str, chosen: set[str] | None = None) -> list[list[frozenset[str]]]:
    """AND over runs of OR over strings of AND over trigrams, in lower case; empty if none is mandatory.

    A run is a stretch of the regex that stands for few strings; what may be absent or long ends it.
    """
    query: list[list[frozenset[str]]] = []
    chosen = set() if chosen is None else chosen

    def flush(run: list[str]) -> None:
        if all(len(s) > 2 for s in run):
            grams = []
            for s in run:
                grams.append(rarest(s, chosen))
                chosen.update(grams[-1])
            query.append(grams)

    def walk(nodes: list) -> None:
        run = [""]
        for node, low, high in nodes:
            one = strings(node, low, high)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = [a + b for a in run for b in one]
                continue
            flush(run)
            run = one if one is not None else [""]
            if one is None and isinstance(node, list) and len(node) == 1 and low > 0:
                walk(node[0])
        flush(run)

    every = parsed(regex)
    if len(every) == 1:
        walk(every[0])
    return query


def trigram_queries(rules: tuple[Rule, ...]) -> dict[str, list[list[frozenset[str]]]]:
    chosen: set[str] = set()
    return {r.kind: trigram_query(r.regex, chosen) for r in rules}


QUERIES = trigram_queries(RULES)


# ---- the index


def inverted_index(docs: DataFrame, queries: dict, blocks: int) -> DataFrame:
    """Posting lists (block, trigram, rows) of the trigrams that queries name, over docs (row, text)."""
    named = sorted({g for q in queries.values() for run in q for s in run for g in s})
    found = F.filter(F.array(*map(F.lit, named)), lambda t: F.contains(F.col("lower"), t))
    postings = docs.select("row", F.lower("text").alias("lower")).select("row", F.explode(found).alias("trigram"))
    return postings.groupBy(F.pmod("row", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("row").alias("rows"))


def candidates(index: DataFrame, queries: dict) -> DataFrame:
    """(row, rules) of the rows that the posting lists leave to each rule with a query."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("of"))
    none = F.array().cast("array<bigint>")
    named = [k for k, q in queries.items() if q]

    def met(kind: str) -> Column:
        rows = lambda g: F.coalesce(F.col("of")[g], none)
        all_of = lambda s: reduce(F.array_intersect, map(rows, sorted(s)))
        any_of = lambda run: reduce(F.array_union, map(all_of, run))
        return reduce(F.array_intersect, map(any_of, queries[kind]))

    left = lists.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), met(k).alias("rows")) for k in named))).alias("x"))
    return left.select("x.kind", F.explode("x.rows").alias("row")).groupBy("row").agg(F.collect_set("kind").alias("rules"))


# ---- verification. Running sums and maxima take as many passes as the count has binary digits.

SPAN = "array<struct<start:int,kind:int,end:int>>"


def bound(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def running(values: Column, join) -> Column:
    """What join makes of each value of an array of ints and all before it."""

    def doubled(acc, p):
        shifted = F.concat(F.array_repeat(F.lit(0), p), F.slice(acc, F.lit(1), F.size(acc) - p))
        return F.zip_with(acc, shifted, lambda x, y: F.coalesce(join(x, y), F.lit(0)))

    steps = lambda of: F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(of))
    return bound(F.transform(values, lambda v: F.coalesce(v, F.lit(0))), lambda of: F.aggregate(steps(of), of, doubled))


def spans_of(rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in `text`: what lies between matches gives their places."""
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    matches = lengths(F.regexp_extract_all("text", F.lit(rule.java), F.lit(0)))
    values = lengths(F.regexp_extract_all("text", F.lit(rule.java), F.lit(rule.group))) if rule.group else None
    between = lengths(F.split("text", rule.java, -1))

    def placed(m: Column) -> Column:
        ends = running(F.zip_with(F.slice(between, F.lit(1), F.size(m)), m, lambda b, n: b + n), lambda x, y: x + y)
        spans = F.zip_with(ends, m, lambda e, n: F.struct((e - n).alias("start"), F.lit(order).alias("kind"), e.alias("end")))
        if values is not None:
            kept = F.filter(F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), v.alias("v"))), lambda x: x["v"] >= rule.least)
            return F.transform(kept, lambda x: x["s"])
        return F.filter(spans, lambda s: s["end"] - s["start"] >= rule.least)

    return bound(matches, placed)


def found_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, which have row and text, with `found`: the spans of all rules in order."""
    queries = QUERIES if rules is RULES else trigram_queries(rules)
    none = F.array().cast(SPAN)
    joined = docs.withColumn("rules", F.array().cast("array<string>"))
    if any(queries.values()):
        blocks = math.ceil(docs.count() / BLOCK_DOCS) or 1
        hits = settled(candidates(settled(inverted_index(docs, queries, blocks)), queries))
        joined = docs.join(hits.withColumnRenamed("row", "hit"), F.col("row") == F.col("hit"), "left").drop("hit")
    every = []
    for k, r in enumerate(rules):
        # A rule without mandatory trigrams scans all texts; a cheap test spares most the spans.
        due = F.array_contains("rules", r.kind) if queries[r.kind] else F.col("text").rlike(r.java.removesuffix("+") + "{%d}" % r.least if r.least and r.regex.endswith("]+") else r.java)
        every.append(F.when(due, spans_of(r, k)).otherwise(none))
    return joined.withColumn("found", F.array_sort(F.concat(*every))).drop("rules")


def _row(text: Column) -> Column:
    """Equal rows share it, so they share postings; a chance meeting costs a look, as texts are verified."""
    return F.xxhash64("doc_id", text)


def _text(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return spread(docs.select("doc_id", text.alias("text"))).withColumn("row", _row(F.col("text")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans of each row."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k for k, r in enumerate(rules) if r.base]
    found = found_spans(_text(docs), rules)
    of_kind = lambda k: F.filter("found", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    only = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(shown(only), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def without_spans(text: Column, found: Column, mark: str) -> Column:
    """text with the mark for each stretch of spans, which are in order and may overlap."""

    def pieced(pieces: Column) -> Column:
        def cut(begin: Column, n: Column) -> Column:
            """n characters from begin on: the pieces that hold them, and of these what is meant."""
            first, last = F.floor(begin / PIECE).cast("int"), F.floor((begin + n - 1) / PIECE).cast("int")
            return F.when(n > 0, F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), F.pmod(begin, F.lit(PIECE)) + 1, n)).otherwise("")

        def marked(before: Column) -> Column:
            kept = F.transform(found, lambda s, i: F.when(s["start"] >= before[i], F.concat(cut(before[i], s["start"] - before[i]), F.lit(mark))).otherwise(""))
            rest = cut(F.element_at(before, -1), F.length(text) - F.element_at(before, -1))
            return F.array_join(F.concat(kept, F.array(rest)), "")

        ends = running(F.transform(found, lambda s: s["end"]), F.greatest)
        return bound(F.concat(F.array(F.lit(0)), ends), marked)

    return bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)), pieced)


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by the mark; the columns stay, null texts stay null."""
    names = docs.columns
    packed = spread(docs).select(F.struct(*names).alias("all"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    packed = packed.select("all", "text", _row(F.col("text")).alias("row"))
    done = found_spans(packed, rules)
    clean = F.when(F.size("found") > 0, without_spans(F.col("text"), F.col("found"), mark)).otherwise(F.col("all.text"))
    done = done.withColumn("clean", clean)
    return done.select(*(F.col("clean").alias(c) if c == "text" else F.col("all")[c].alias(c) for c in names))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS k, 6 AS least, regexp_extract_all(text, '{assign}', 0, 'i') AS x, regexp_extract_all(text, '{assign}', 2, 'i') AS v, regexp_split_to_array(text, '(?i){assign}') AS b FROM d
  UNION ALL SELECT doc_id, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT doc_id, 'pem', 3, 0, regexp_extract_all(text, '{pem}'), regexp_extract_all(text, '{pem}'), regexp_split_to_array(text, '{pem}') FROM d
  UNION ALL SELECT doc_id, 'jwt', 4, 0, regexp_extract_all(text, '{jwt}'), regexp_extract_all(text, '{jwt}'), regexp_split_to_array(text, '{jwt}') FROM d
  UNION ALL SELECT doc_id, 'hub', 5, 0, regexp_extract_all(text, '{hub}'), regexp_extract_all(text, '{hub}'), regexp_split_to_array(text, '{hub}') FROM d
  UNION ALL SELECT doc_id, 'slack', 6, 0, regexp_extract_all(text, '{slack}'), regexp_extract_all(text, '{slack}'), regexp_split_to_array(text, '{slack}') FROM d),
p AS (SELECT doc_id, kind, k, i, x[i] AS match, (list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(x[1:i - 1], lambda y: length(y))), 0))::BIGINT AS start
  FROM m, unnest(range(1, len(x) + 1)) AS u(i) WHERE length(v[i]) >= least),
s AS (SELECT doc_id, k, kind, kind || ':' || start || ':' || (start + length(match)) AS span, start FROM p),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""
for _r in RULES:
    SQL = SQL.replace("{%s}" % _r.kind, _r.sql.replace("'", "''"))
