r"""URL filters: rules first, then the ratio of two character language models.

A rule names a host, subdomains included, and what the path begins with; the longest that fits decides.
The urls that rules decide are what the method learns from: two Markov models of variable order, one of
accepted and one of rejected urls, smoothed by Witten and Bell's rule, in which a context counts as far as it
was seen often enough. A url's score is the difference of its log-likelihoods under the two, divided
by its length; the threshold is the one of least balanced error on urls that were kept out of the models.

All of it is DataFrame functions. Distinct urls count once. Their positions are grouped by distinct gram
(a character and the `order` before it) in a partial aggregate; the models are worked out for distinct grams, and go
back to the positions by a join, in which grams so frequent that they'd be a hot key are broadcast (their
number is bounded, as each holds a share of all rows) and all others meet by shuffle. Log-ratios are whole
millionths, so sums are exact in any order.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and is judged as it
stands (null as empty); equal urls get equal verdicts; where no rule decides any url the models say nothing
and all are allowed; a very long url costs in proportion to its length; an empty table gives an empty result;
columns besides page_id and url are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import BROADCAST_IDS, settled, spread

#: Characters of context at most; times that a context must have been seen; characters that there might be.
ORDER, SEEN, ALPHABET = 4, 4, 65_536
#: Whole numbers in a log-ratio of 1, and in a step of the scores that thresholds are taken from.
UNIT, STEP = 1_000_000, 10_000
#: A key with more than one row in so many is hot; there are no more of them than that.
HOT_SHARE = 10_000
#: Characters that stand before and behind a url in the models.
BEGIN, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """`of` is a host and, from its first slash on, what the path begins with."""

    verdict: str
    of: str

    @property
    def parts(self) -> tuple[str, str]:
        host, slash, rest = self.of.partition("/")
        return host, slash + rest


# The rules of the contract.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands behind the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as it is written, or null; of equal ones the first."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.of)):
        name, begins = r.parts
        found = F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(begins), F.lit(r.of)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[Rule, ...]) -> Column:
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(rule == r.of, F.lit(r.verdict)).otherwise(verdict)
    return verdict


def key_of(url: Column) -> Column:
    """32 bytes that stand for a url of any length in a join."""
    return F.unhex(F.sha2(url, 256))


def grams_of(text: Column, order: int) -> Column:
    """The gram of each character of text and of the end mark: up to `order` characters before it, and itself."""

    def cut(marked: Column) -> Column:
        last = F.sequence(F.lit(2), F.size(marked))
        return F.transform(last, lambda i: F.array_join(F.slice(marked, F.greatest(i - order, F.lit(1)), F.least(i, F.lit(order + 1))), ""))

    # A variable of a lambda is worked out once, an expression inside one for each element.
    marked = F.concat(F.array(F.lit(BEGIN)), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.array(F.lit(END)))
    return F.get(F.transform(F.array(marked), cut), F.lit(0))


def dealt_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows with what `found` has for their key, of which it holds each once with `n`, the rows that have it.

    A small table is broadcast whole. Of a larger one the keys with more than a HOT_SHARE-th of the rows are,
    so that no key of the shuffled rest is a task of its own.
    """
    if found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(found), key)
    hot = found.where(F.col("n") > (found.agg(F.sum("n")).first()[0] // HOT_SHARE))
    often = F.broadcast(hot.select(key, F.lit(True).alias("often")))
    marked = rows.join(often, key, "left")
    many, few = marked.where("often").drop("often"), marked.where("often IS NULL").drop("often")
    return many.join(F.broadcast(hot), key).unionByName(few.join(found, key))


def log_ratios(full: DataFrame, order: int = ORDER, seen: int = SEEN) -> DataFrame:
    """gram, n and `ratio` of full (gram, n, good, bad: occurrences in all, in accepted and in rejected urls).

    A model's probability of a character is, from no context to the longest, (its count there + distinct
    characters there * the shorter context's probability) / (all counts there + distinct characters there).
    """
    parts = lambda g: F.transform(F.sequence(F.lit(1), F.length(g)), lambda k: F.struct(k.alias("size"), F.right(g, k).alias("part")))
    known = full.where("good + bad > 0").select(F.explode(parts(F.col("gram"))).alias("p"), "good", "bad")
    counts = settled(known.groupBy("p.size", "p.part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    sums = [F.sum("good").alias("all_good"), F.count_if(F.col("good") > 0).alias("kinds_good"), F.sum("bad").alias("all_bad"), F.count_if(F.col("bad") > 0).alias("kinds_bad")]
    contexts = counts.where("size > 1").groupBy(F.expr("left(part, size - 1)").alias("context")).agg(*sums).where(F.col("all_good") + F.col("all_bad") >= seen)
    # A character without context has the totals, one row.
    totals = [int(x or 0) for x in counts.where("size = 1").agg(*sums).first()]
    names = ("all_good", "kinds_good", "all_bad", "kinds_bad")

    asked = full.select("gram", F.explode(parts(F.col("gram"))).alias("p")).select("gram", "p.size", "p.part")
    asked = asked.join(counts.select("part", "good", "bad"), "part", "left").withColumn("context", F.expr("left(part, size - 1)"))
    first = asked.where("size = 1").select("gram", "size", "good", "bad", *(F.lit(t).cast("long").alias(n) for t, n in zip(totals, names)))
    later = asked.where("size > 1").join(contexts, "context").select("gram", "size", "good", "bad", *names)
    steps = first.unionByName(later).select("gram", F.struct("size", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("good", "bad", *names))).alias("step"))

    def model(kind: str) -> Column:
        def shorter(p: Column, s: Column) -> Column:
            total = s[f"all_{kind}"] + s[f"kinds_{kind}"]
            return F.when(total > 0, (s[kind] + s[f"kinds_{kind}"] * p) / total).otherwise(p)

        return F.aggregate("steps", F.lit(1.0) / F.lit(float(ALPHABET)), shorter)

    ratio = F.round((F.log(model("good")) - F.log(model("bad"))) * UNIT).cast("long")
    found = steps.groupBy("gram").agg(F.array_sort(F.collect_list("step")).alias("steps")).select("gram", ratio.alias("ratio"))
    return full.select("gram", "n").join(found, "gram")


def threshold(scored: DataFrame) -> int:
    """The score from which urls are accepted: of least balanced error on scored (score, good), the nearest to 0 of several, then the smaller.

    Candidates are 0 and the steps of the scores; without urls of both kinds it is 0.
    """
    bins = scored.groupBy(F.floor(F.col("score") / STEP).cast("long").alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # As many rows as there are steps between the least and the largest score, which the alphabet bounds.
    rows = sorted([(0, 0, 0), *((r.bin, r.good, r.bad) for r in bins.collect())])
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0
    best, lost, kept = [], 0, bad
    for at, g, b in [*rows, (rows[-1][0] + 1, 0, 0)]:
        best.append((lost * bad + kept * good, abs(at), at))
        lost, kept = lost + g, kept - b
    return min(best)[2] * STEP


def judged_urls(urls: DataFrame, rules: tuple[Rule, ...], order: int = ORDER) -> DataFrame:
    """key, n and verdict of distinct urls (url, n): the rule's, or the method's with its score."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = verdict_of(rule_of(host, path, rules), rules)
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)) == 2
    # The number of a row is only stable once it is written.
    known = settled(urls.select("url", "n", ruled.alias("ruled"), held.alias("held"), F.monotonically_increasing_id().alias("id")))
    at = known.select("id", "ruled", "held", F.explode(grams_of(F.col("url"), order)).alias("gram"))
    learned = lambda kind: F.count_if((F.col("ruled") == kind) & ~F.col("held"))
    full = settled(at.groupBy("gram").agg(F.count("*").alias("n"), learned("allow").alias("good"), learned("block").alias("bad")))
    ratios = settled(log_ratios(full, order))
    # What rules decide is scored only where the threshold is taken from it.
    due = at.where("ruled IS NULL OR held").select("id", "gram")
    score = F.floor(F.sum("ratio") / F.count("*")).cast("long").alias("score")
    scored = settled(dealt_join(due, ratios, "gram").groupBy("id").agg(score))
    judged = known.join(scored, "id", "left")
    bar = threshold(judged.where("ruled IS NOT NULL AND score IS NOT NULL").select("score", (F.col("ruled") == "allow").alias("good")))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= bar, "allow").otherwise("block"))
    return settled(judged.select(key_of(F.col("url")).alias("key"), "n", verdict.alias("verdict"), F.when(F.col("ruled").isNull(), F.col("score")).alias("score")))


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and, where the method judged, score (millionths a character) of each page."""
    asked = spread(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")))
    judged = judged_urls(asked.groupBy("url").agg(F.count("*").alias("n")), rules)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    found = dealt_join(asked.select("page_id", key_of(F.col("url")).alias("key"), host.alias("host"), path.alias("path")), judged, "key")
    return found.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), "verdict", "score")


def _sql() -> str:
    """The same in SQL, order by order."""
    fits = lambda r: f"WHEN (host = '{r.parts[0]}' OR suffix(host, '.{r.parts[0]}')) AND starts_with(path, '{r.parts[1]}') THEN '{r.of}'"
    rule = "CASE " + " ".join(fits(r) for r in sorted(RULES, key=lambda r: -len(r.of))) + " END"
    ruled = "CASE rule " + " ".join(f"WHEN '{r.of}' THEN '{r.verdict}'" for r in RULES) + " END"
    at = range(1, ORDER + 2)
    column = lambda c, k: f"coalesce(max({c}) FILTER (k = {k}), 0)::DOUBLE AS {c}{k}"
    columns = ", ".join(column(f"{c}_{m}", k) for k in at for m in ("good", "bad") for c in ("own", "sum", "kinds"))
    chain = ""
    for k in at:
        one = lambda m: f"CASE WHEN sum_{m}{k} + kinds_{m}{k} > 0 THEN (own_{m}{k} + kinds_{m}{k} * p_{m}) / (sum_{m}{k} + kinds_{m}{k}) ELSE p_{m} END AS p_{m}"  # noqa: B023, E731
        chain += f"m{k} AS (SELECT * REPLACE ({one('good')}, {one('bad')}) FROM m{k - 1}),\n"
    return rf"""
WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
q AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
r AS (SELECT *, {rule} AS rule FROM q),
u AS (SELECT DISTINCT url, {ruled} AS ruled, hex(url) AS h FROM r),
v AS (SELECT url, ruled, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 = 2 AS held FROM u, crc),
g AS (SELECT url, ruled, held, unnest(list_transform(range(2, length(url) + 3), lambda i: substring(chr(2) || url || chr(3), greatest(i - {ORDER}, 1), least(i, {ORDER + 1})))) AS gram FROM v),
f AS (SELECT gram, count(*) FILTER (ruled = 'allow' AND NOT held) AS good, count(*) FILTER (ruled = 'block' AND NOT held) AS bad FROM g GROUP BY gram),
p AS (SELECT gram, good, bad, k, right(gram, k) AS part, left(right(gram, k), k - 1) AS context FROM f, range(1, {ORDER + 2}) AS r(k) WHERE k <= length(gram)),
n AS (SELECT k, part, context, sum(good) AS own_good, sum(bad) AS own_bad FROM p WHERE good + bad > 0 GROUP BY ALL),
c AS (SELECT k, context, sum(own_good) AS sum_good, count(*) FILTER (own_good > 0) AS kinds_good, sum(own_bad) AS sum_bad, count(*) FILTER (own_bad > 0) AS kinds_bad FROM n GROUP BY ALL HAVING k = 1 OR sum_good + sum_bad >= {SEEN}),
m0 AS (SELECT gram, {columns}, 1.0::DOUBLE / {ALPHABET} AS p_good, 1.0::DOUBLE / {ALPHABET} AS p_bad
  FROM (SELECT p.gram, p.k, own_good, own_bad, sum_good, kinds_good, sum_bad, kinds_bad FROM p JOIN c USING (k, context) LEFT JOIN n USING (k, part)) GROUP BY gram UNION ALL
  SELECT gram, {", ".join(["0"] * 6 * len(at))}, 1.0::DOUBLE / {ALPHABET}, 1.0::DOUBLE / {ALPHABET} FROM f WHERE NOT EXISTS (SELECT * FROM c)),
{chain}s AS (SELECT url, any_value(ruled) AS ruled, any_value(held) AS held, floor(sum(round((ln(p_good) - ln(p_bad)) * {UNIT})::BIGINT)::DOUBLE / count(*))::BIGINT AS score FROM g JOIN m{ORDER + 1} USING (gram) GROUP BY url),
b AS (SELECT floor(score / {STEP})::BIGINT AS bin, ruled = 'allow' AS good FROM s WHERE ruled IS NOT NULL AND held),
a AS (SELECT bin AS edge FROM b UNION SELECT 0 UNION SELECT max(greatest(bin, 0)) + 1 FROM b HAVING count(*) > 0),
e AS (SELECT edge, (SELECT count(*) FROM b WHERE good AND bin < edge) * (SELECT count(*) FROM b WHERE NOT good) + (SELECT count(*) FROM b WHERE NOT good AND bin >= edge) * (SELECT count(*) FROM b WHERE good) AS error FROM a),
bar AS (SELECT CASE WHEN (SELECT count(DISTINCT good) FROM b) = 2 THEN (SELECT edge FROM e ORDER BY error, abs(edge), edge LIMIT 1) * {STEP} ELSE 0 END AS bar)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN score >= bar THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN ruled IS NULL THEN score END AS score
FROM r JOIN s USING (url), bar
"""


SQL = _sql()
