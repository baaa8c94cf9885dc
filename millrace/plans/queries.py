"""Every record operator over the test tables. Lists come out as strings, orders as a `place` column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.operators import calls, commands, forms, gate, opportunities, priorities, records, triage, views
from millrace.plans import inputs as I
from millrace.sources import store
from millrace.sources.shared import temporary
from millrace.streaming.fold import add_batch, stored_priorities, stream_priorities
from millrace.streaming.moods import stream_moods

#: What views take as now.
AS_OF = "2024-01-30 12:00:00"
PRIORITY = ["owner_id", "seq", "context", "higher", "lower", "confidence", "evidence"]


def _hundredths(c: str = "confidence"):
    return (F.col(c) * 100).cast("int").alias(c)


def _listed_priorities(rows: DataFrame) -> DataFrame:
    return rows.select(*PRIORITY[:5], _hundredths(), F.col("evidence").cast("long").alias("evidence"))


def _priorities(s: SparkSession, d: str) -> DataFrame:
    return priorities.fold_priorities(I.corrections(s, d))


def _facts(s, d):
    return records.remember_facts(I.facts(s, d))


def _goals(s, d):
    return I.goals(s, d).withColumn("goal", F.trim("goal"))


def _observations(s, d):
    return records.log_observations(I.observations(s, d))


def _permissions(s, d):
    return gate.current_permissions(I.permission_entries(s, d))


def _scored(s, d):
    return opportunities.score_opportunities(I.opportunities(s, d))


def _maps(s, d):
    return forms.profile_maps(forms.profiles(I.profile_entries(s, d)))


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


# ---- priorities


def priorities_fold(s, d):
    return _priorities(s, d).select(*PRIORITY[:5], _hundredths(), F.col("evidence").cast("long").alias("evidence"))


def priorities_stream(s, d):
    """The fold as a stream over the events file, run to its end."""
    t = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(t).option("pathGlobFilter", "events.parquet").parquet(d)
    path = temporary(s, "stream")
    stream_priorities(I.correction_log(events).drop("ts"), f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return _listed_priorities(stored_priorities(s, f"{path}/out"))


def _arrived(s, d):
    """The corrections as five micro-batches that overlap in seq, and a base after each second one; the folder."""
    path = temporary(s, "arrivals")
    for k in range(5):
        add_batch(I.corrections(s, d).where(F.pmod(F.floor(F.col("seq") / 3), F.lit(5)) == k), path, k + 1, every=2)
    return path


def priorities_arrivals(s, d):
    """The fold in order of arrival: base and runs."""
    return _listed_priorities(stored_priorities(s, _arrived(s, d)))


def priorities_changed(s, d):
    """Those that the last of five micro-batches changed."""
    return _listed_priorities(stored_priorities(s, _arrived(s, d), since=4))


def priority_lookup(s, d):
    wanted = I.owners(s, d).select("owner_id", F.lit("CLICK").alias("context"), F.lit("COST").alias("a"), F.lit("Speed").alias("b"))
    found = priorities.find_priority(_priorities(s, d), wanted)
    return found.select("owner_id", "found.seq", "found.higher", "found.lower", (F.col("found.confidence") * 100).cast("int").alias("confidence"))


def priorities_set(s, d):
    """Declarations alone: the last stands, with the first one's context and evidence 1."""
    declared = I.corrections(s, d).where("confidence is not null")
    return priorities.fold_priorities(declared).select(*PRIORITY[:5], _hundredths(), F.col("evidence").cast("long").alias("evidence"))


def priorities_for(s, d):
    return priorities.priorities_for(_priorities(s, d), "IC").select("owner_id", "seq", "context", _hundredths(), "place")


def basis_priorities(s, d):
    return priorities.basis_priorities(I.topics(s, d), _priorities(s, d)).select("owner_id", "topic_id", "place", "context", "higher", _hundredths())


def basis_facts(s, d):
    return priorities.basis_facts(I.topics(s, d), _facts(s, d)).select("owner_id", "topic_id", "seq", "fact")


def explain_basis(s, d):
    pairs = F.transform("priorities", lambda p: F.concat_ws(">", p["higher"], p["lower"]))
    shown = {"priorities": F.array_join(pairs, ";"), "facts": F.array_join(F.transform("facts", lambda f: f["fact"]), ";")}
    return priorities.explain_basis(I.topics(s, d), _priorities(s, d), _facts(s, d), shown).select("owner_id", "topic_id", *shown)


def corrections_count(s, d):
    return I.corrections(s, d).where("confidence is null").groupBy("owner_id").agg(F.count("*").alias("n"))


# ---- facts, goals, observations


def facts_remember(s, d):
    return _facts(s, d).select("owner_id", "seq", "fact", "category")


def facts_remember_once(s, d):
    """Each owner's categories as facts: many repeat, within an owner and between owners."""
    return records.remember_once(_facts(s, d).withColumn("fact", F.col("category"))).select("owner_id", "seq", "fact")


def facts_forget(s, d):
    return records.forget(_facts(s, d), "RING").select("owner_id", "seq", "fact")


def facts_forget_count(s, d):
    return _facts(s, d).groupBy("owner_id").agg(records.forget_count("RING").alias("removed"))


def goals_add(s, d):
    return records.add_goals(I.goals(s, d)).select("owner_id", "seq", "goal", "active")


def goals_close(s, d):
    return records.close_goals(_goals(s, d), "HIGH").select("owner_id", "seq", "active", "closed")


def goals_close_count(s, d):
    return _goals(s, d).groupBy("owner_id").agg(records.close_count("HIGH").alias("closed"))


def goals_active(s, d):
    return records.active_goals(_goals(s, d)).select("owner_id", "seq", "goal")


def observations_log(s, d):
    return _observations(s, d).select("owner_id", "seq", "note", "category")


def observations_newest(s, d):
    return records.newest(_observations(s, d), 5).select("owner_id", "seq", "place")


# ---- permissions and actions


def permissions_current(s, d):
    return _permissions(s, d)


def permissions_audit(s, d):
    return gate.permission_actions(I.permission_entries(s, d)).select("owner_id", "seq", "category", "level", "cap", "outcome")


def permissions_rejected(s, d):
    return gate.rejected_permissions(I.permission_entries(s, d)).select("owner_id", "seq", "level")


def permission_lookup(s, d):
    return gate.with_permission(I.requests(s, d), _permissions(s, d)).select("owner_id", "seq", "level", "cap")


def gate_authorize(s, d):
    return gate.authorize(I.requests(s, d), _permissions(s, d)).select("owner_id", "seq", "category", "level", "cap", "reason", "allowed")


def gate_denials(s, d):
    return gate.denials(gate.authorize(I.requests(s, d), _permissions(s, d)))


def gate_authorize_at(s, d):
    """Each request by the permission in force at its place in the log."""
    return gate.authorize_at(I.logged_requests(s, d), I.permission_log(s, d)).select("owner_id", "seq", "category", "level", "cap", "reason", "allowed")


def gate_denials_at(s, d):
    return gate.denials(gate.authorize_at(I.logged_requests(s, d), I.permission_log(s, d)))


def actions_log(s, d):
    return records.log_actions(I.actions(s, d))


def actions_newest(s, d):
    return records.newest(records.log_actions(I.actions(s, d)), 10).select("owner_id", "seq", "category", "place")


def actions_all(s, d):
    return records.newest(records.log_actions(I.actions(s, d)), 0).select("owner_id", "seq", "place")


def actions_but_oldest(s, d):
    return records.newest(records.log_actions(I.actions(s, d)), -3).select("owner_id", "seq", "place")


# ---- opportunities


def opportunities_score(s, d):
    return _scored(s, d).select("owner_id", "seq", "what", (F.col("score") * 100).cast("int").alias("score"), "status")


def opportunities_resolve(s, d):
    return opportunities.resolve_many(_scored(s, d), [("PART 12", "done"), ("part 1", "late")]).select("owner_id", "seq", "resolved", "outcome")


def opportunities_resolve_count(s, d):
    return _scored(s, d).groupBy("owner_id").agg(opportunities.resolve_count("PART 12").alias("resolved"))


def opportunities_pending(s, d):
    return opportunities.pending(opportunities.resolve(_scored(s, d), "part 12")).select("owner_id", "seq", (F.col("score") * 100).cast("int").alias("score"), "place")


def opportunities_top(s, d):
    return opportunities.pending(_scored(s, d), 10).select("owner_id", "seq", "place")


# ---- commands in the log


def facts_forget_log(s, d):
    return commands.facts_after(_facts(s, d), I.commands(s, d)).select("owner_id", "seq", "fact")


def goals_close_log(s, d):
    return commands.goals_after(_goals(s, d), I.commands(s, d)).select("owner_id", "seq", "active", "closed_by")


def opportunities_resolve_log(s, d):
    return commands.opportunities_after(_scored(s, d), I.commands(s, d)).select("owner_id", "seq", "resolved", "outcome", "resolved_by")


def commands_counts(s, d):
    return commands.command_counts(I.commands(s, d), _facts(s, d), _goals(s, d), _scored(s, d)).select("owner_id", "seq", "kind", "needle", "changed")


# ---- triage


def triage_messages(s, d):
    listed = [F.array_join(c, ";").alias(c) for c in ("scam_flags", "billing_flags", "money", "deadlines")]
    return triage.triage(I.messages(s, d)).select("msg_id", *listed, "scam_score", "billing_score", "verdict", "advice")


def triage_verdicts(s, d):
    return triage.triage(I.messages(s, d)).groupBy("verdict").agg(F.count("*").alias("n"))


def triage_priorities(s, d):
    return triage.message_priorities(I.messages(s, d), _priorities(s, d)).select("owner_id", F.col("topic_id").alias("msg_id"), "context", "higher", _hundredths(), "place")


# ---- labels, profiles, forms


def labels_normalize(s, d):
    return forms.label_meanings(I.form_labels(s, d), list(I.NAMES)).select("owner_id", "form_id", "pos", F.col("key").alias("field"), F.col("hidden").alias("is_sensitive"), F.col("named").alias("slot"), "held")


def profile_fields(s, d):
    return forms.profiles(I.profile_entries(s, d))


def profile_forget(s, d):
    left = forms.forget_field(_maps(s, d), "Given name")
    return left.select("owner_id", "removed", F.array_join(F.map_keys("profile"), ",").alias("fields"))


def forms_classify(s, d):
    return forms.classify_labels(I.form_labels(s, d), _maps(s, d), list(I.NAMES)).select("owner_id", "form_id", "pos", "label", "value", "why", "slot")


def forms_fill(s, d):
    done = forms.fill_forms(I.form_labels(s, d), _maps(s, d), list(I.NAMES))
    left = F.array_join(F.transform("needs_you", lambda x: x["label"]), ",")
    filled = F.array_join(F.transform(F.map_entries("filled"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return done.select("owner_id", "form_id", filled.alias("filled"), left.alias("needs_you"), "coverage")


def forms_refused(s, d):
    n = F.col("form_id") + F.col("pos")
    values = I.form_labels(s, d).withColumn("value", I.pick(n, "plain", " vault:card_number ", "VAULT:nothing", "vault:bad name"))
    return forms.refused_values(values, list(I.NAMES)).select("owner_id", "form_id", "pos", "blocked", "missing")


def references(s, d):
    n = F.col("form_id") + F.col("pos")
    return I.form_labels(s, d).select("owner_id", "form_id", "pos", L.is_reference(I.pick(n, "plain", " vault:card_number ", "VAULT:nothing", "vault:bad name")).alias("is_reference"))


def draft_guidance(s, d):
    shown = {"n_priorities": F.size("priorities"), "n_facts": F.size("facts")}
    return forms.draft_guidance(I.topics(s, d), _priorities(s, d), _facts(s, d), _maps(s, d), shown).select("owner_id", "topic_id", *shown, "signer")


# ---- views


def owner_states(s, d):
    return views.owner_states(I.owners(s, d), _scored(s, d), I.corrections(s, d).where("confidence is null"), _observations(s, d), _as_of())


def owner_states_stream(s, d):
    """Each owner's last mood of a stream over all records, run to its end."""
    path, provider = temporary(s, "moods"), "spark.sql.streaming.stateStore.providerClass"
    I.mood_records(s, _scored(s, d), d).write.parquet(f"{path}/in")
    records = s.readStream.schema(s.read.parquet(f"{path}/in").schema).parquet(f"{path}/in").withWatermark("ts", "0 seconds")
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/out")
    before = s.conf.get(provider)
    s.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream_moods(records).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        s.conf.set(provider, before)
    return s.read.parquet(f"{path}/out").groupBy("owner_id").agg(F.max_by("mood", F.struct("batch", "at")).alias("mood"))


def daily_brief(s, d):
    learned = I.corrections(s, d).where("confidence is null")
    done = views.daily_brief(I.owners(s, d), _goals(s, d), _scored(s, d), records.log_actions(I.actions(s, d)), _observations(s, d), learned, _as_of())
    join = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ";"), F.lit("")).alias(c)
    return done.select("owner_id", "mood", join("active_goals", "goal"), join("opportunities", "what"), join("recent_actions", "outcome"), join("recent_observations", "note"), "corrections_learned_from")


def snapshot(s, d):
    learned = I.corrections(s, d).where("confidence is null")
    done = views.snapshot(I.owners(s, d), _priorities(s, d), _facts(s, d), _goals(s, d), learned)
    join = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ";"), F.lit("")).alias(c)
    return done.select("owner_id", join("priorities", "context"), join("facts", "fact"), join("active_goals", "goal"), "corrections_learned_from")


# ---- tool calls


def calls_rejected(s, d):
    return calls.rejected(I.calls(s, d)).select("owner_id", "seq", "tool", "problem")


def _applied(s, d, name):
    return calls.applied(I.calls(s, d), (name,))[name]


def calls_priorities(s, d):
    return _applied(s, d, "priorities").select(*PRIORITY[:5], _hundredths(), F.col("evidence").cast("long").alias("evidence"))


def calls_facts(s, d):
    return _applied(s, d, "facts").select("owner_id", "seq", "fact", "category")


def calls_goals(s, d):
    return _applied(s, d, "goals").select("owner_id", "seq", "goal", "active", "closed_by")


def calls_actions(s, d):
    return _applied(s, d, "actions").select("owner_id", "seq", "category", "description", "amount", "outcome")


def calls_opportunities(s, d):
    return _applied(s, d, "opportunities").select("owner_id", "seq", "what", (F.col("score") * 100).cast("int").alias("score"), "resolved", "outcome")


def calls_profile(s, d):
    return _applied(s, d, "profile")


# ---- the store


def _documents(s, d):
    """An owner's facts and goals as a document, in stored order."""
    listed = lambda df, fields, name: df.groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(name))
    known = listed(_facts(s, d), ["fact", "category"], "facts").join(listed(_goals(s, d), ["goal", "active"], "goals"), "owner_id", "full")
    return known.withColumn("owner", F.col("owner_id").cast("string")).drop("owner_id")


def store_saved(s, d):
    """Goals read back from the second save, which is made from the first."""
    path = temporary(s, "store")
    store.write_documents(_documents(s, d), path)
    store.update_documents(s, path, lambda saved: saved.withColumn("goals", F.filter("goals", lambda g: g["active"])))
    return store.collection(store.read_saved(s, path), "goals").select("owner_id", "seq", "goal", "active")


def store_loaded(s, d):
    """Facts of the documents that can be read; every seventh owner's is cut short."""
    return store.collection(store.parsed_documents(_texts(s, d))[0], "facts").select("owner_id", "seq", "fact", "category")


def _texts(s, d):
    text = F.to_json(F.struct("facts", "owner"))
    cut = F.when(F.col("owner").cast("long") % 7 == 0, F.left(text, F.lit(9))).otherwise(text)
    return _documents(s, d).where("facts is not null").select(F.col("owner").alias("store_path"), cut.alias("text"))


def store_broken(s, d):
    return store.parsed_documents(_texts(s, d))[1].select("store_path", F.length("text").alias("n"))


def store_appended(s, d):
    """An event log appended to twice, by owner."""
    path, log = temporary(s, "log"), I.corrections(s, d).drop("ts")
    for half in (0, 1):
        store.append_events(log.where(F.col("seq") % 2 == half), path)
    return store.read_events(s, path).groupBy("owner_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


QUERIES = {f.__name__: f for f in (
    priorities_fold, priorities_stream, priorities_arrivals, priorities_changed, priorities_set, priority_lookup, priorities_for, basis_priorities, basis_facts, explain_basis, corrections_count,
    facts_remember, facts_remember_once, facts_forget, facts_forget_count, goals_add, goals_close, goals_close_count, goals_active, observations_log, observations_newest,
    permissions_current, permissions_audit, permissions_rejected, permission_lookup, gate_authorize, gate_denials, gate_authorize_at, gate_denials_at, facts_forget_log, goals_close_log, opportunities_resolve_log, commands_counts, actions_log, actions_newest, actions_all, actions_but_oldest,
    opportunities_score, opportunities_resolve, opportunities_resolve_count, opportunities_pending, opportunities_top, triage_messages, triage_verdicts, triage_priorities,
    labels_normalize, profile_fields, profile_forget, forms_classify, forms_fill, forms_refused, references, draft_guidance, owner_states, owner_states_stream, daily_brief, snapshot,
    calls_rejected, calls_priorities, calls_facts, calls_goals, calls_actions, calls_opportunities, calls_profile,
    store_saved, store_loaded, store_broken, store_appended,
)}
