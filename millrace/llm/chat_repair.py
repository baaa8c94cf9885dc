r"""Conversation structure repair by error-correcting Earley parsing.

A row's role and its fault make it one of a few symbols. A weighted grammar of roles says what a sound conversation
is, `(s?(ua)+)?`; besides what it asks for, its productions delete a row, take it in another role, or take a row
that isn't there. All of them are left-linear, so every chart item begins with the conversation and a column of
the chart is a few nonterminals, each with the least (cost, audit) that leads to it: prediction and
completion move between nonterminals, a scan takes a row. The start symbol, completed in the last column, yields the
repair. Audits are compared as they grow; what all of them have behind them is put aside every `REBASE`
rows and only its rank compared, so time and memory are in proportion to a conversation's length.

Faults are found in DataFrame functions: a repeated row by a window over rows of equal role and text, which spreads one
conversation's rows. Symbols then meet by conversation and are parsed, in order, without texts; in a second pass
each conversation's audit comes before its rows, which are streamed through the digest of what was repaired.
A task holds a conversation's symbols and audit, a byte or so a row, and one text at a time.

Defined results: null role, text, conv_id or turn stand for one space where they are written; null conv_ids are one
conversation; a null turn comes first; rows of a turn come by role, then by the SHA-256 of role and text; an empty role
is none of the grammar's; repeated rows are repeated rows (the later ones duplicates); a conversation that loses
all rows has zeros and empty texts; a very long text is one row; an empty table gives an empty result;
columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import in_batches, settled

# What edits cost, and the letters of an audit.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTER = {"delete": "D", "insert": "I", "keep": "K", "rerole": "R"}
ROLE = {"u": "user", "a": "assistant"}
#: Symbols: the role's initial (o for any other), a capital where the text is truncated; a row that must go.
SYMBOLS, BAD = "suao", "x"
#: The grammar, left-linear: nonterminal -> nonterminal it follows and role it asks for. `Open` derives nothing.
GRAMMAR = (("System", "Open", "s"), ("Asked", "Open", "u"), ("Asked", "System", "u"), ("Asked", "Answered", "u"), ("Answered", "Asked", "a"))
SOUND = ("Open", "Answered")
#: Letters of an audit that are compared in full.
REBASE = 1_024
#: Conversations of up to this many rows whose repairs a task remembers, and how many of them.
SHORT, REMEMBERED = 24, 100_000


def _scans(symbol: str) -> list[tuple[str, str, int, str]]:
    """(from, to, cost, letter) of all ways to take a row: error productions delete it or give it another role."""
    ways = [(x, x, DELETE, LETTER["delete"]) for x in ("Open", "System", "Asked", "Answered")]
    if symbol == BAD:
        return ways
    late = TRUNCATED * symbol.isupper()
    for to, after, role in GRAMMAR:
        if symbol.lower() == role:
            ways.append((after, to, KEEP + late, LETTER["keep"]))
        elif role in ROLE:
            ways.append((after, to, REROLE + late, LETTER["rerole"]))
    return ways


SCANS = {x: _scans(x) for x in (*SYMBOLS, *SYMBOLS.upper(), BAD)}
INSERTS = [(after, to) for to, after, role in GRAMMAR if role in ROLE]


def _completed(column: dict) -> dict:
    """The column with the rows that aren't there taken, cheapest items first, until nothing gets better."""
    agenda = sorted(column, key=column.get)
    while agenda:
        x = agenda.pop(0)
        cost, rank, tail = column[x]
        for after, to in INSERTS:
            item = (cost + INSERT, rank, tail + LETTER["insert"])
            if after == x and (to not in column or item < column[to]):
                column[to] = item
                agenda = sorted({*agenda, to}, key=column.get)
    return column


def parse(symbols: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; the least audit of several.

    An item is (cost, rank of what was put aside, audit behind it). Two audits of equal cost over the same rows never
    begin one another, since equal letters cost the same, so the least stays least whatever follows.
    """
    aside: list[list[tuple[int, str]]] = []
    column = _completed({"Open": (0, 0, "")})
    for at, symbol in enumerate(symbols):
        if at and at % REBASE == 0:
            # Inserts behind the last row are not yet settled and stay.
            cut = {x: (rank, tail.rstrip(LETTER["insert"])) for x, (_, rank, tail) in column.items()}
            ranks = sorted(set(cut.values()))
            aside.append(ranks)
            column = {x: (cost, ranks.index(cut[x]), tail[len(cut[x][1]) :]) for x, (cost, _, tail) in column.items()}
        after: dict = {}
        for x, to, cost, letter in SCANS[symbol]:
            if x in column:
                c, rank, tail = column[x]
                item = (c + cost, rank, tail + letter)
                if to not in after or item < after[to]:
                    after[to] = item
        column = _completed(after)
    cost, rank, tail = min(column[x] for x in SOUND if x in column)
    parts = [tail]
    for ranks in reversed(aside):
        rank, part = ranks[rank]
        parts.append(part)
    return cost, "".join(reversed(parts))


_short = functools.lru_cache(REMEMBERED)(parse)


def repair(symbols: str) -> tuple[int, str]:
    return _short(symbols) if len(symbols) <= SHORT else parse(symbols)


class Repaired:
    """Follows an audit over a conversation's rows and gives the lines that it leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.asked = audit, 0, False

    def _missing(self):
        while self.audit.startswith(LETTER["insert"], self.at):
            yield f"{self._next_role()}:"
            self.at += 1

    def _next_role(self) -> str:
        self.asked = not self.asked
        return ROLE["u" if self.asked else "a"]

    def take(self, role: str, text: str):
        yield from self._missing()
        letter = self.audit[self.at]
        self.at += 1
        if letter == LETTER["rerole"]:
            yield f"{self._next_role()}:{text}"
        elif letter == LETTER["keep"]:
            self.asked = role.startswith("u")
            yield f"{role}:{text}"

    def rest(self):
        yield from self._missing()
        if self.at != len(self.audit):
            raise ValueError("the audit is of more rows")


# ---- damage and faults, row by row

def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `lost` of each row as damaged; lost rows stay, marked and without role and text."""
    how = F.pmod(F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")), F.lit(20))
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(_shown("text"), "[.!?]", "")).otherwise(_shown("text"))
    role = F.when(how == 4, ROLE["u"]).otherwise(_shown("role"))
    lost = how == 0
    rows = turns.select("conv_id", "turn", F.when(~lost, role).alias("role"), F.when(~lost, text).alias("text"), lost.alias("lost"), F.explode(F.array_repeat(F.lit(1), F.when(how == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """rows with `digest`, which tells rows of one turn and role apart and orders them."""
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def last_sign(text: Column) -> Column:
    """The last character that isn't white space, or an empty text; found from the end, in time of the text's length."""
    kept = F.rtrim(F.translate(text, "\x09\x0a\x0b\x0c\x0d", " " * 5))
    return F.right(kept, F.lit(1))


def symbols(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role's initial, digest, lost, fault and symbol of each placed row: texts are left behind."""
    last = last_sign(F.col("text"))
    initial = F.left("role", F.lit(1))
    short = rows.select("conv_id", "turn", initial.alias("initial"), "role", "digest", "lost", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    # Equal rows of a conversation meet, not its whole rows; lost rows and blank ones are no copies of any, and spread.
    own = F.when(F.col("lost") | F.col("blank"), F.xxhash64("turn"))
    same = Window.partitionBy("conv_id", "digest", "own").orderBy("turn")
    fault = F.when(F.col("lost"), F.lit(None)).when(F.col("blank"), "blank").when(F.row_number().over(same) > 1, "duplicate").when(F.col("cut"), "truncated")
    told = short.withColumn("own", own).withColumn("fault", fault)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), BAD).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return told.select("conv_id", "turn", "initial", "role", "digest", "lost", "fault", symbol.alias("symbol"))


# ---- by conversation

_SUMS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]


class _Facts:
    def __init__(self):
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.symbols: list[str] = []
        self.illegal, self.initial, self.first, self.last, self.turns = 0, None, None, None, 0

    def take(self, turn, initial: str, fault: str | None, symbol: str) -> None:
        if fault:
            self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.symbols.append(symbol)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self) -> tuple:
        cost, audit = repair("".join(self.symbols))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, cost, audit


def _grouped(batches, names: list[str], begin, take, row, columns):
    """A batch of a row for each conversation; rows come sorted by it and may span batches."""
    now, held, kind = None, None, None

    def out(done):
        arrays = [pa.array([d[0] for d in done], kind), *(pa.array([d[1][i] for d in done], t) for i, (_, t) in enumerate(columns))]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(n for n, _ in columns)])

    for b in batches:
        kind, done = b.schema.field("conv_id").type, []
        for conv, *values in zip(b.column("conv_id").to_pylist(), *(b.column(n).to_pylist() for n in names)):
            if held is None or conv != now:
                if held is not None:
                    done.append((now, row(held)))
                now, held = conv, begin()
            take(held, values)
        yield out(done)
    if held is not None:
        yield out([(now, row(held))])


def _parsed(batches):
    def take(held: _Facts, values: list) -> None:
        turn, initial, lost, fault, symbol = values
        if not lost:
            held.take(turn, initial, fault, symbol)

    return _grouped(batches, ["turn", "initial", "lost", "fault", "symbol"], _Facts, take, _Facts.row, _SUMS)


class _Digest:
    """The digest of a conversation's repaired lines, joined by line ends."""

    def __init__(self):
        self.facts, self.lines, self.sha, self.begun = None, None, hashlib.sha256(), False

    def add(self, lines) -> None:
        for line in lines:
            self.sha.update(f"\n{line}".encode() if self.begun else line.encode())
            self.begun = True

    def take(self, values: list) -> None:
        head, role, text, *facts = values
        if head:
            self.facts, self.lines = facts, Repaired(facts[-1])
        else:
            self.add(self.lines.take(role, text))

    def row(self) -> tuple:
        self.add(self.lines.rest())
        return *self.facts, self.sha.hexdigest()


def _digested(batches):
    names = ["head", "role", "text", *(n for n, _ in _SUMS)]
    return _grouped(batches, names, _Digest, _Digest.take, _Digest.row, [*_SUMS, ("repaired_sha256", pa.string())])


def _schema(df: DataFrame, columns) -> object:
    schema = df.select("conv_id").schema
    for name, kind in columns:
        schema = schema.add(name, "string" if kind == pa.string() else "long")
    return schema


def audits(rows: DataFrame) -> DataFrame:
    """gaps, faults, illegal neighbours, cost and audit of each conversation of placed rows."""
    # Of equal rows of a turn the one that isn't a duplicate comes first.
    later = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    short = symbols(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", later)
    return short.select("conv_id", "turn", "initial", "lost", "fault", "symbol").mapInArrow(_parsed, _schema(rows, _SUMS))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What audits found, with the digest of each conversation's repaired rows."""
    names = [n for n, _ in _SUMS]
    none = lambda n, t: F.lit(None).cast("string" if t == pa.string() else "long").alias(n)
    said = rows.where("NOT lost").select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", "digest", *(none(n, t) for n, t in _SUMS))
    kind = dict(rows.dtypes)
    heads = found.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast(kind["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), *names)
    both = heads.unionByName(said).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "role", "digest")
    columns = [*_SUMS, ("repaired_sha256", pa.string())]
    return both.select("conv_id", "head", "role", "text", *names).mapInArrow(_digested, _schema(rows, columns))


def structure_repair(turns: DataFrame) -> DataFrame:
    """The damaged conversations, their faults, and the cheapest repair of each."""
    rows = placed(damaged(in_batches(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))))
    return repaired(rows, settled(audits(rows)))


def _sql() -> str:
    """The same in SQL: a row at a time, the best (cost, audit, repaired text) that leads to each nonterminal."""
    add = lambda x, cost, letter, line="''": f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {x}.t || {line}}}"
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    same = "chr(10) || role || ':' || text"
    said = {k: f"chr(10) || '{v}:' || text" for k, v in ROLE.items()}
    took = lambda x, to: f"CASE WHEN bad THEN {far} WHEN known = '{to}' THEN {add(x, 'late', 'K', same)} ELSE {add(x, 'late + 1', 'R', said[to])} END"
    empty = lambda x, to: add(x, INSERT, "I", f"chr(10) || '{ROLE[to]}:'")
    return rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS h FROM conversations),
o AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS how FROM h, crc),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE how WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM o WHERE how <> 0),
e AS (SELECT *, sha256(length(role) || ':' || role || text) AS digest, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
n AS (SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest, seen) AS i FROM e),
y AS (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS known, coalesce(fault IN ('blank', 'duplicate'), false) AS bad, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS o, {far} AS s, {{'c': {INSERT}, 'a': 'I', 't': chr(10) || 'user:'}} AS u, {{'c': {2 * INSERT}, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, o1, s1, u2, list_min([a1, {empty('u2', 'a')}]) FROM (SELECT *, list_min([u1, {empty('o1', 'u')}, {empty('s1', 'u')}, {empty('a1', 'u')}]) AS u2 FROM (
    SELECT w.conv_id, y.i, {add('o', DELETE, 'D')} AS o1, list_min([{add('s', DELETE, 'D')}, CASE WHEN NOT bad AND known = 's' THEN {add('o', 'late', 'K', same)} ELSE {far} END]) AS s1,
      list_min([{add('u', DELETE, 'D')}, {took('o', 'u')}, {took('s', 'u')}, {took('a', 'u')}]) AS u1, list_min([{add('a', DELETE, 'D')}, {took('u', 'a')}]) AS a1
    FROM w JOIN y ON w.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = w.i + 1))),
z AS (SELECT conv_id, arg_max(list_min([o, a]), i) AS best FROM w GROUP BY conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM y GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(best.t[2:]) AS repaired_sha256
FROM z LEFT JOIN f ON z.conv_id IS NOT DISTINCT FROM f.conv_id
"""


SQL = _sql()
