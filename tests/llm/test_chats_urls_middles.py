"""Structure repair, url filters and fill-in-middle against enumeration, loops and SQL, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_repair, fill_middle, url_filter

TURN = "conv_id long, turn long, role string, text string"


def told(sql, name, frame, rows_of):
    con = duckdb.connect()
    con.register("made", frame)
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM made")
    return rows_of(con.execute(sql).df())


# ---- 11


def enumerated(symbols, most=3):
    """The least (cost, audit) of all sequences of edits with up to `most` inserts."""
    best, sound = None, re.compile(r"(s?(ua)+)?\Z")

    def go(i, roles, cost, audit, left):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(symbols) and sound.match(roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        for r in "ua" if left else "":
            go(i, roles + r, cost + 5, audit + "I", left - 1)
        if i < len(symbols):
            one = symbols[i]
            go(i + 1, roles, cost + 2, audit + "D", left)
            if one != "x":
                late = 5 * one.isupper()
                go(i + 1, roles + one.lower(), cost + late, audit + "K", left)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + late, audit + "R", left)

    go(0, "", 0, "", most)
    return best


def test_parser_finds_the_cheapest_and_least_repair():
    rng = random.Random(6)
    every = ["".join(p) for n in range(3) for p in itertools.product("suaoSUAOx", repeat=n)]
    for s in every + ["".join(rng.choices("suaoSUAOx", weights=(2, 4, 4, 1, 1, 2, 2, 1, 1), k=rng.randrange(3, 7))) for _ in range(400)]:
        assert chat_repair.parse(s) == enumerated(s), s


def test_audits_put_aside_keep_their_order(monkeypatch):
    rng = random.Random(7)
    for _ in range(200):
        s = "".join(rng.choices("suaoSUAOx", k=rng.randrange(90)))
        whole = chat_repair.parse(s)
        for every in (1, 2, 5):
            monkeypatch.setattr(chat_repair, "REBASE", every)
            assert chat_repair.parse(s) == whole
        monkeypatch.undo()


def test_a_long_conversation_takes_linear_room():
    cost, audit = chat_repair.parse("ua" * 30_000 + "uu" * 20_000)
    assert (cost, len(audit)) == (20_000, 100_000) and audit.startswith("K" * 60_000)


def damaged_by_a_loop(rows):
    """{conv_id: rows after damage}, in order."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        shown = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if how == 4 else shown(role), "" if how == 1 else re.sub("[.!?]", "", shown(text)) if how == 2 else shown(text)
        out[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(x, key=key) for c, x in out.items()}


def repaired_by_a_loop(rows):
    out = {}
    for conv, own in damaged_by_a_loop(rows).items():
        faults, seen, symbols = [], set(), ""
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else known.upper() if fault else known
        cost, audit = chat_repair.parse(symbols)
        lines, left, asked = [], iter(own), False
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            asked = row[1].startswith("u") if letter == "K" else not asked
            lines.append(f"{row[1] if letter == 'K' else 'user' if asked else 'assistant'}:{row[2] if row else ''}")
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_of_odd_conversations(spark, rows_of):
    rng = random.Random(8)
    texts = ["Well.", "No", "", None, "  \t", "Why?\n ", "a.b", "x" * 50_000 + ".", "é!", "\x1c", "ok."]
    rows = [(c, rng.choice([None, 3, *range(40)]), rng.choice(["user", "assistant", "system", None, "", "tool", "User", "sales"]), rng.choice(texts)) for c in [None, 1, 2, *range(3, 40)] for _ in range(rng.randrange(1, 9))]
    rows += rows[:20] + [(77, t, "user", "again.") for t in range(300)]
    rows += [(500 + c, t, "user", "Alone.") for c in range(60) for t in range(1)]  # some of these lose all rows
    turns = spark.createDataFrame(rows, TURN).withColumns({c: F.lit(1) for c in ("fault", "symbol", "digest", "audit", "cost", "lost", "head", "copy", "own")})
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in chat_repair.structure_repair(turns).collect()}
    assert got == repaired_by_a_loop(rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())
    frame = turns.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    assert rows_of(chat_repair.structure_repair(turns).toPandas()) == told(chat_repair.SQL, "conversations", frame, rows_of)
    assert chat_repair.structure_repair(spark.createDataFrame([], TURN)).count() == 0


def test_the_audit_must_fit_the_rows():
    lines = chat_repair.Repaired("IKR")
    assert list(lines.take("assistant", "a.")) == ["user:", "assistant:a."]
    with pytest.raises(ValueError):
        list(lines.rest())


# ---- 12

PAGE = "page_id long, url string, html string"


def rule_by_a_loop(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r.of for r in url_filter.RULES if (host == r.parts[0] or host.endswith("." + r.parts[0])) and path.startswith(r.parts[1])]
    return host, path, max(fits, key=len, default=None)


def scores_by_loops(urls):
    """The two models from plain counts: score of each distinct url without rule or held out, and the threshold."""
    verdict = {r.of: r.verdict for r in url_filter.RULES}
    ruled = {u: verdict.get(rule_by_a_loop(u)[2]) for u in urls}
    held = {u: zlib.crc32(u.encode()) % 4 == 2 for u in urls}
    counts = {"allow": {}, "block": {}}
    for u in urls:
        if ruled[u] and not held[u]:
            text = "\x02" + u + "\x03"
            for i in range(1, len(text)):
                for k in range(min(4, i) + 1):
                    counts[ruled[u]].setdefault(text[i - k : i], {}).setdefault(text[i], 0)
                    counts[ruled[u]][text[i - k : i]][text[i]] += 1

    def ratio(context, c):
        p = {"allow": 1 / 65536, "block": 1 / 65536}
        for k in range(len(context) + 1):
            h = context[len(context) - k :]
            own = {m: counts[m].get(h, {}) for m in p}
            if k and sum(sum(x.values()) for x in own.values()) < 4:
                break
            for m, x in own.items():
                total = float(sum(x.values()) + len(x))
                p[m] = (x.get(c, 0) + len(x) * p[m]) / total if total else p[m]
        return math.floor(abs(d := (math.log(p["allow"]) - math.log(p["block"])) * 1e6) + 0.5) * (1 if d > 0 else -1)

    score = {}
    for u in urls:
        text = "\x02" + u + "\x03"
        every = [ratio(text[max(0, i - 4) : i], text[i]) for i in range(1, len(text))]
        score[u] = math.floor(sum(every) / len(every))
    known = [(score[u], ruled[u] == "allow") for u in urls if ruled[u] and held[u]]
    good, bad = sum(g for _, g in known), sum(not g for _, g in known)
    steps = {0, *(s // 10_000 for s, _ in known)}
    if not good or not bad:
        return score, 0
    error = lambda t: sum(g and s // 10_000 < t for s, g in known) * bad + sum(not g and s // 10_000 >= t for s, g in known) * good
    return score, min((error(t), abs(t), t) for t in {*steps, max(steps) + 1})[2] * 10_000


ODD_URLS = [None, "", "no scheme", "://", "http://net", "HTTP://A.NET/", "x://EXAMPLE.net/en/?q", "x://example.net/en", "x://notnet/", "a://b://c.net/", "x://example.com/de/#f", "x://é.org/fr/漢🙂", "x://q.org/fr/\n/a?b", "x://É.NET/", "x://" + "long/" * 20_000, "x://u@a.net:80/"]


@pytest.mark.parametrize("limit", [None, 0])
def test_urls_against_loops(spark, monkeypatch, rows_of, limit):
    """With no broadcast too, when frequent keys go apart from the rest."""
    if limit is not None:
        monkeypatch.setattr(url_filter, "BROADCAST_IDS", 20)
        monkeypatch.setattr(url_filter, "HOT_SHARE", 50)
    rng = random.Random(9)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['spam', 'news', 'blog'])}.example.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(30)}" for _ in range(150)]
    urls = ODD_URLS + made + made[:40] + [made[0]] * 100
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, made[1], "x")], PAGE).withColumns({c: F.lit(1) for c in ("key", "n", "host", "rule", "score", "id", "gram", "often")})
    got = url_filter.url_filter(pages).collect()
    score, bar = scores_by_loops(list({u or "" for u in urls}))
    verdict = {r.of: r.verdict for r in url_filter.RULES}
    assert len(got) == len(urls) + 1
    for r in got:
        u = made[1] if r.page_id is None else urls[r.page_id]
        host, path, rule = rule_by_a_loop(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        own = score[u or ""]
        assert r.verdict == (verdict[rule] if rule else "allow" if own >= bar else "block") and (r.score is None if rule else r.score == own), (u, own, bar)
    if limit is None:
        pages = pages.where("url IS NULL OR length(url) < 999")  # SQL takes the square of a url's length
        frame = pages.select("page_id", "url").toPandas().astype({"page_id": "Int64"})
        assert rows_of(url_filter.url_filter(pages).toPandas()) == told(url_filter.SQL, "pages", frame, rows_of)


def test_urls_without_examples(spark):
    assert url_filter.url_filter(spark.createDataFrame([], PAGE)).count() == 0
    free = spark.createDataFrame([(1, "x://a.com/", None), (2, None, None)], PAGE)
    assert {(r.page_id, r.verdict, r.rule) for r in url_filter.url_filter(free).collect()} == {(1, "allow", None), (2, "allow", None)}


def test_urls_are_judged_without_python(spark, sf):
    plan = url_filter.url_filter(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_models_tell_kinds_apart(spark):
    """Urls that no rule decides go with the ones that look like them."""
    words = {"allow": ("reading", "library", "history"), "block": ("casino", "jackpot", "betting")}
    rows, n = [], 0
    for kind, host in (("allow", "org/fr"), ("block", "net/fr")):
        for i in range(120):
            name, end = host.split("/")
            rows.append((n := n + 1, f"http://{words[kind][i % 3]}{i}.{name}/{end}/{words[kind][(i + 1) % 3]}", kind))
    asked = [(1000 + i, f"http://{w}{i}.com/xx/{w}", k) for i, (k, w) in enumerate((k, w) for k, ws in words.items() for w in ws * 5)]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(spark.createDataFrame(rows + asked, "page_id long, url string, kind string")).collect()}
    assert sum(got[i] == k for i, _, k in asked) >= 0.9 * len(asked)


# ---- 13


def test_ranks_match_a_regex():
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choices(["a", "b", " ", "\n", "é", "漢", "🙂", "<", "P", ">", "<P>", "\x1c"], k=rng.randrange(25)))
        events = fill_middle.Events(t)
        for unit, pattern in (("code_point", "(?s)."), ("run", r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")):
            at = [m.start() for m in re.finditer(pattern, t)]
            ranks = events.ranks(unit)
            assert ranks[2] == len(at) and [fill_middle.looked_up(ranks, i, len(t)) for i in range(len(at) + 1)] == [*at, len(t)]
        assert [(at, fill_middle.SENTINELS[k]) for at, k in events.sentinels] == [(m.end(), m[0]) for m in re.finditer("<[PSM]>", t)]
        a, b = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
        assert events.words(a, b) == sum(a <= m.start() < b for m in re.finditer(r"[^\x20\x09-\x0D]+", t))


def middle_by_a_loop(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(text) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return len(text), *(("spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"))


def test_middles_of_odd_documents(spark, rows_of):
    texts = [None, "", "<", "<P", "a<S>b", "<M>", ">P<", "é 漢字 🙂\n", " " * 9, "word " * 60_000, "<<P", "S>", *(f"text {i} <" for i in range(150))]
    rows = [*enumerate(texts), (None, "no id"), (5, "same id"), *enumerate(texts[:9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "h1", "restored")})
    made = fill_middle.fill_middle(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=key) == sorted(((i, *middle_by_a_loop(i, t)) for i, t in rows), key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    back = fill_middle.restored(fill_middle.fill_middle(docs)).collect()
    assert sorted((str(r.doc_id), r.restored) for r in back) == sorted((str(i), t or "") for i, t in rows)
    frame = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    assert rows_of(fill_middle.fill_in_middle(docs).toPandas()) == told(fill_middle.SQL, "documents", frame, rows_of)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_middles_on_bounds_of_runs(spark):
    docs = spark.createDataFrame([(i, f"one two  three\nfour <{i} six ") for i in range(60)], "doc_id long, text string")
    marks = ("[[p]]", "[[s]]", "[[m]]")
    for r in fill_middle.restored(fill_middle.fill_middle(docs, "run", marks, plain_percent=0), marks).collect():
        text = f"one two  three\nfour <{r.doc_id} six "
        bounds = {m.start() for m in re.finditer(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text)} | {len(text)}
        assert r.n == 12 and r.prefix_chars in bounds and r.prefix_chars + r.middle_chars in bounds
        assert r.output.count("[[") == 3 and r.restored == text


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("a b", "<S>", "<M>"), ("aa", "b", "c"), ("<x<", "<S>", "<M>"), ("", "s", "m")])
def test_sentinels_are_checked(spark, bad):
    with pytest.raises(ValueError):
        fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string"), sentinels=bad)


def test_output_of_another_form_is_refused():
    for out, form in (("<P>a<S>b", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c", "spm"), ("<P>a<S>b<M>c<M>", "psm")):
        with pytest.raises(ValueError):
            fill_middle.restored_text(out, form)
