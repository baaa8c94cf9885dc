"""Truth tables and edge cases of the record operators."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.operators import gate, opportunities, priorities, records, triage, views
from millrace.sources import store

EVENT = "owner_id long, seq long, context string, higher string, lower string, confidence double"


def looped(events):
    """The fold as a loop: (owner, context, pair) -> (confidence, evidence, higher, context as first written)."""
    out = {}
    for o, _, ctx, hi, lo, conf in sorted(events, key=lambda e: e[:2]):
        key = (o, ctx.lower(), frozenset((hi.lower(), lo.lower())))
        if conf is not None:
            c = round(min(max(conf, 0.05), 0.99), 2)
            old = out.get(key)
            out[key] = (c, old[1] if old else 1, hi, old[3] if old else ctx)
        elif key not in out:
            out[key] = (0.55, 1, hi, ctx)
        else:
            c, n, up, first = out[key]
            if up.lower() == hi.lower():
                out[key] = (round(c + (1 - c) * 0.15, 2), n + 1, up, first)
            else:
                c = round(c * 0.7, 2)
                out[key] = (0.5, n + 1, hi, first) if c < 0.25 else (c, n + 1, up, first)
    return out


def some_events(n, seed=3):
    rng = random.Random(seed)
    pairs = [("A", "b"), ("B", "a"), ("a", "C"), ("c", "A")]
    return [(rng.randrange(3), i, rng.choice(("Work", "work", "home")), *rng.choice(pairs), rng.choice((None,) * 9 + (-1.0, 0.37, 1.5))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"bits": (6, 8, 9), "listed": 3}, {"bits": (12,), "listed": 3}])
def test_fold_equals_a_loop(spark, how):
    events = some_events(900)
    got = priorities.fold_priorities(spark.createDataFrame(events, EVENT), **how).collect()
    want = looped(events)
    assert len(got) == len(want)
    for r in got:
        c, n, hi, ctx = want[r.owner_id, r.context.lower(), frozenset((r.higher.lower(), r.lower.lower()))]
        assert (float(r.confidence), r.evidence, r.higher, r.context) == (c, n, hi, ctx)


def test_hot_fold_of_sparse_seqs(spark):
    events = [(o, s * s * 1_000_003, *rest) for o, s, *rest in some_events(600, seed=5)]
    got = priorities.fold_priorities(spark.createDataFrame(events, EVENT), listed=2).collect()
    want = looped(events)
    assert {(r.owner_id, r.context, float(r.confidence), r.evidence, r.higher) for r in got} == {(k[0], x[3], x[0], x[1], x[2]) for k, x in want.items()}


def test_equal_ids_of_two_owners_stay_apart(spark):
    topics = spark.createDataFrame([(1, 7, "work"), (2, 7, "work"), (1, 8, None)], "owner_id long, topic_id long, topic string")
    held = spark.createDataFrame([(1, 1, "work", "a", "b", 0.9, 1), (2, 1, "work", "c", "d", 0.8, 1)], "owner_id long, seq long, context string, higher string, lower string, confidence double, evidence int")
    facts = spark.createDataFrame([(1, 1, "secret1 work"), (2, 1, "secret2 work")], "owner_id long, seq long, fact string")
    got = {(r.owner_id, r.topic_id): r for r in priorities.explain_basis(topics, held, facts).collect()}
    assert [f.fact for f in got[1, 7].facts] == ["secret1 work"] and [p.higher for p in got[2, 7].priorities] == ["c"] and got[2, 7].priorities[0].place == 1
    assert [p.higher for p in got[1, 8].priorities] == ["a"] and len(got[1, 8].facts) == 1  # a null topic is an empty one
    once = records.remember_once(spark.createDataFrame([(1, 1, "x"), (2, 2, "x"), (1, 3, "x")], "owner_id long, seq long, fact string"))
    assert sorted((r.owner_id, r.seq) for r in once.collect()) == [(1, 1), (2, 2)]


def test_a_save_is_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "saved")
    made = lambda x: spark.createDataFrame([("o", [(x, "c", None)])], "owner string, facts array<struct<fact:string,category:string,added:string>>")
    store.write_documents(made("x"), path)
    store.write_documents(store.read_saved(spark, path).drop("store_path").unionByName(made("y"), True), path)
    failing = made("z").withColumn("owner", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.write_documents(failing, path)
    assert sorted(r.fact for r in store.collection(store.read_saved(spark, path), "facts").collect()) == ["x", "y"]


def test_saves_that_race_lose_nothing(spark, tmp_path):
    """Writers at the same time each add an owner; a save made from an older version is refused."""
    from concurrent.futures import ThreadPoolExecutor

    path, made = str(tmp_path / "saved"), lambda x: spark.createDataFrame([(x, [("f", "c", None)])], "owner string, facts array<struct<fact:string,category:string,added:string>>")
    assert store.current_version(spark, path) == 0 and store.read_saved(spark, path).count() == 0
    assert store.write_documents(made("o"), path, 0) == 1
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: store.update_documents(spark, path, lambda saved: saved.unionByName(made(f"o{i}"), True), 20), range(4)))
    assert sorted(versions) == [2, 3, 4, 5]
    assert sorted(r.owner for r in store.read_saved(spark, path).collect()) == ["o", "o0", "o1", "o2", "o3"]
    with pytest.raises(store.SaveConflict):
        store.write_documents(made("late"), path, 4)
    # The number is taken by one alone, whatever was seen before.
    made("late").write.json(f"{path}/_new-late")
    assert not store.numbered(spark, "_new-late", path, 5)
    assert store.current_version(spark, path) == 5 and store.read_saved(spark, path).count() == 5
    assert store.read_saved(spark, path, 1).count() == 1 and store.write_documents(made("o9"), path) == 6


def test_a_scope_is_its_thread_s(spark):
    """What another thread settles while a scope is open stays when it closes."""
    from concurrent.futures import ThreadPoolExecutor

    from millrace.sources import shared

    with ThreadPoolExecutor(1) as pool:
        with shared.scratch(spark):
            other = pool.submit(lambda: shared.settled(spark.range(3))).result()
        assert other.count() == 3


def test_scratch_removes_what_was_settled(spark):
    import os

    from millrace.sources import shared

    with shared.scratch(spark):
        path = shared.settled(spark.range(3)).inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0]
        assert os.path.isdir(path.replace("///", "/"))
    assert not os.path.isdir(path.replace("///", "/"))


def test_transition_points():
    path, s = [], priorities.transition(0, 1)
    for _ in range(16):
        path.append((s - 1) % 101)
        s = priorities.transition(s, 1)
    assert path == [55, 62, 68, 73, 77, 80, 83, 86, 88, 90, 92, 93, 94, 95, 96, 97] and (s - 1) % 101 == 97
    s = priorities.transition(0, 0)
    turned = [s := priorities.transition(s, 1) for _ in range(3)]
    assert [(x - 1) % 101 for x in turned] == [39, 27, 50] and (turned[-1] - 1) // 101 == 1


def test_empty_fold(spark):
    assert priorities.fold_priorities(spark.createDataFrame([], EVENT)).count() == 0


def test_gate_truth_table(spark):
    perms = spark.createDataFrame([(1, 1, " Pay ", "act", 100.0), (1, 2, "mail", "act", None), (1, 3, "zero", "act", 0.0), (1, 4, "look", "observe", None), (1, 5, "mail", "always", 1.0)], "owner_id long, seq long, category string, level string, cap double")
    asks = [("PAY", None), ("pay", 100.0), ("pay", 100.01), ("pay", -5.0), ("mail", 1e9), ("zero", 0.01), ("zero", 0.0), ("look", 1.0), ("none", 1.0)]
    req = spark.createDataFrame([(1, i, c, "d", a) for i, (c, a) in enumerate(asks)], "owner_id long, seq long, category string, description string, amount double")
    done = gate.authorize(req, gate.current_permissions(perms))
    assert [r.reason for r in done.orderBy("seq").collect()] == ["granted", "granted", "cap", "granted", "granted", "cap", "granted", "level", "level"]
    assert gate.denials(done).count() == 4 and gate.rejected_permissions(perms).count() == 1 and gate.permission_actions(perms).count() == 4


def test_score_grid(spark):
    rows = [("x", a, g, r, u) for a in ("y", " ", None) for g in ("z", "") for r in (True, False, None) for u in (None, -1.0, 0.0, 0.5, 1.0, 7.0)]
    got = opportunities.score_opportunities(spark.createDataFrame(rows, "what string, aligns_with string, advances_goal string, reduces_risk boolean, urgency double")).collect()
    for r in got:
        want = 20 + 25 * (r.aligns_with == "y") + 20 * (r.advances_goal == "z") + 15 * bool(r.reduces_risk) + round(20 * r.urgency)
        assert round(float(r.score) * 100) == want and r.status == ("interrupt" if want >= 75 else "brief" if want >= 40 else "hold")


def test_limits(spark):
    log = spark.createDataFrame([(1, i) for i in range(5)], "owner_id long, seq long")
    seqs = lambda n: [r.seq for r in records.newest(log, n).orderBy("place").collect()]
    assert seqs(2) == [4, 3] and seqs(0) == [4, 3, 2, 1, 0] and seqs(-3) == [4, 3] and seqs(9) == [4, 3, 2, 1, 0]


def test_empty_needle_is_refused(spark):
    facts = spark.createDataFrame([(1, "a")], "owner_id long, fact string")
    with pytest.raises(ValueError):
        records.forget(facts, "")
    assert records.forget(facts, "", allow_empty=True).count() == 0


def test_unicode_space_is_trimmed(spark):
    row = records.remember_facts(spark.createDataFrame([(1, 1, "   x y 　", None)], "owner_id long, seq long, fact string, category string")).first()
    assert (row.fact, row.category) == ("x y", "general")


def test_triage_verdicts(spark):
    bodies = {
        "Urgent: verify your account, police on the way": "likely_scam", "police": "suspicious", "keep this\nconfidential": "routine", "free trial ends": "money_watch", "cancel fee": "routine",
        "costs $5": "needs_decision", "due\n12 March": "needs_decision", "": "routine", "click here": "routine", "gift card": "suspicious", "URGENT, do not tell, police": "likely_scam",
    }
    rows = [(i, None if i % 2 else "", b) for i, b in enumerate(bodies)] + [(99, None, None)]
    got = {r.msg_id: r for r in triage.triage(spark.createDataFrame(rows, "msg_id long, subject string, body string")).collect()}
    assert [got[i].verdict for i in range(len(bodies))] == list(bodies.values()) and got[99].verdict == "routine"
    many = triage.triage(spark.createDataFrame([(1, "a", " ".join(f"${i},000.00" for i in range(1, 9)))], "msg_id long, subject string, body string")).first()
    assert many.money == [f"${i},000.00" for i in range(1, 6)]
    every = " ".join(("urgent", "gift card", "police", "prize", "bitcoin"))
    assert triage.triage(spark.createDataFrame([(1, "", every)], "msg_id long, subject string, body string")).first().scam_score == 100


def test_triage_takes_rules_of_any_shape(spark):
    rules = {
        r"free (?:money|cash)": "free cash", "plain": "a plain word", r"\b(?:a|b)?\s?zebra\b": "zebra", r"(?:cash)? now": "x now", r"(?:ab|cd)|ef": "ef", r"(?:x?y|z)": "y", r"(?:[pq]r|st)": "qr",
        r"\b(?:(?:no|so) more|less)\b": "so more", r"(?:\d+|one) euro": "12 euro", r"(?i:AB|cd) e": "ab e", r"(?:gh|ij)\b": "ij",
    }
    rows = spark.createDataFrame(list(enumerate(rules.values())), "msg_id long, body string").withColumn("subject", F.lit(None).cast("string"))
    signals = tuple(triage.Signal(r, 10, r) for r in rules)
    got = {r.msg_id: r.scam_flags for r in triage.triage(rows, signals, ()).collect()}
    assert all(r in got[i] for i, r in enumerate(rules))
    assert all(triage.first_letters(s.regex) for s in triage.SCAM + triage.BILLING)


def test_labels(spark):
    want = {"E-mail": None, "E-mail address": "address_line1", "Company name": "full_name", "Community": "address_line2", "Capacity": "city", "Statement": "province", "Cancelled?": "phone", "Zip  CODE*": "postal_code", "full_name": "full_name", "": None}
    rows = spark.createDataFrame([(x,) for x in want], "label string").select("label", L.field_of(F.col("label")).alias("f"), L.field_of(F.col("label"), True).alias("w"))
    got = {r.label: r for r in rows.collect()}
    assert {k: r.f for k, r in got.items()} == want
    assert got["Community"].w is None and got["Company name"].w == "full_name"
    marks = spark.createDataFrame([(x,) for x in ("Opinion", "Colour", "Housing", "CVV")], "label string").select(L.sensitive(F.col("label")).alias("s"))
    assert [r.s for r in marks.collect()] == [True, False, True, True]


def test_store_keeps_broken_documents_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"facts": [{"fact": "x", "category": "c"}], "permissions": {"pay": {"level": "act", "cap": 5}}, "profile": {"city": "Bern"}}')
    (tmp_path / "b.json").write_text('{"facts": [')
    good, bad = store.read_documents(spark, str(tmp_path))
    assert store.collection(good, "facts").select("seq", "fact").collect() == [(0, "x")]
    assert store.permissions(good).select("category", "level", "cap").collect() == [("pay", "act", 5.0)]
    assert store.profile_fields(good).select("field", "value").collect() == [("city", "Bern")]
    assert bad.count() == 1


def test_log_and_memory(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "seq long, fact string")
    store.append_events(a, str(tmp_path / "log"))
    store.append_events(a.withColumn("seq", F.lit(2).cast("long")), str(tmp_path / "log"))
    assert sorted(r.seq for r in store.read_events(spark, str(tmp_path / "log")).collect()) == [1, 2]
    facts = spark.createDataFrame([("x",)], "fact string")
    assert store.remember_line(facts, "x").count() == 1 and store.remember_line(facts, "X").count() == 2
    times = store.stored_times(spark.createDataFrame([("2024-05-01T10:00:00+0200",), ("bad",)], "added string"), "added")
    assert [str(r.added) for r in times.collect()] == ["2024-05-01 08:00:00", "None"]


def test_owner_states_over_all_rows(spark):
    """Each mood, and each over owners and corrections of every remainder."""
    moods = ("protective", "charged", "curious", "happy", "thinking", "calm")
    now, old = "2024-01-30 11:00:00", "2024-01-01 00:00:00"
    opps, seen, noted = [], [], []
    for i in range(18):
        k = (i + i // 6) % 6
        opps += [(i, k == 0, "interrupt" if k < 2 else "brief" if k == 2 else "hold", False), (i, True, "interrupt", True)]
        seen += [(i, now if k < 4 and n == i % 3 else old) for n in range(3)]
        noted += [(i, now if k < 5 else old)]
    made = views.owner_states(
        spark.range(18).withColumnRenamed("id", "owner_id"), spark.createDataFrame(opps, "owner_id long, reduces_risk boolean, status string, resolved boolean"),
        spark.createDataFrame(seen, "owner_id long, ts string"), spark.createDataFrame(noted, "owner_id long, ts string"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"),
    )
    assert {r.owner_id: r.mood for r in made.collect()} == {i: moods[(i + i // 6) % 6] for i in range(18)}


def test_labels_are_worked_out_once_each(spark):
    """What labels mean is what the expressions say of each row, null and repeated labels too, but is read from one row a distinct label."""
    from millrace.functions import labels as L
    from millrace.operators import forms

    names, rows = ["card_number", "pin_home"], [(i, x) for i, x in enumerate(["E-mail", "Card number", None, "", "Community", "PIN", "E-mail", None, "Shoe size"] * 3)]
    df, stored = spark.createDataFrame(rows, "pos long, label string"), F.array(*map(F.lit, names))
    got = forms.label_meanings(df, names)
    label = F.col("label")
    want = df.select("pos", "label", L.sensitive(label).alias("hidden"), L.field_of(label).alias("key"), L.slot_for(label, stored).alias("held"), L.suggested_slot(label).alias("named"))
    by_pos = lambda frame: sorted(frame.select(*want.columns).collect(), key=lambda r: r.pos)
    assert by_pos(got) == by_pos(want) and got.count() == 27
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text and "regexp_replace" not in text
