"""Streams against their batch twins, timers, restarts and sinks of the jobs.

The Kafka connector is not installed here: file sources and folders stand in for topics.
"""

import json
import random
import time

import pytest
from conftest import SMALL, values
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.models import outcome as M
from runlens.operators import adaptation as A
from runlens.operators import snapshots as S
from runlens.operators import training as R
from runlens.plans.queries import STALE_MS, shown
from runlens.schemas import FLAT_EVENT, SESSION_EVENT, WAITING_FIGHT
from runlens.sinks import tables
from runlens.sinks.topics import to_messages
from runlens.sources.events import decode_fights, guard_triggers, read_events
from runlens.sources.tables import read_lake, read_landed
from runlens.sources.telemetry import gameplay_events, gameplay_records
from runlens.streaming import jobs
from runlens.streaming import profile as P

ONCE = {"availableNow": True}


def finish(query):
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()


def feed(events, folder):
    """Append events as one more file, newer than those before it."""
    events.select(*FLAT_EVENT.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def source(spark, folder):
    return read_events(spark, "parquet", path=folder, schema=FLAT_EVENT, maxFilesPerTrigger="1")


def sentinel(spark, moment):
    """An event of a run of its own that moves the watermark."""
    row = {"event_id": -1, "timestamp": moment, "event_type": "none", "run_id": "sentinel"}
    return spark.createDataFrame(
        [tuple(row.get(name) for name in FLAT_EVENT.fieldNames())], FLAT_EVENT)


def texts(frame):
    return sorted(row["value"] for row in frame.collect())


def test_profile_job_in_parts_with_a_restart(spark, tmp_path):
    """Three files and a restart give the messages and the cache of one batch."""
    events = gameplay_events(spark, SMALL)
    low, high = events.agg(F.min("timestamp"), F.max("timestamp")).first()
    horizon = high + 4 * STALE_MS
    folder, cache, topics = (str(tmp_path / name) for name in ("in", "cache", "topics"))
    rules = P.Rules(kill_history=4, kill_min=2, stale_ms=STALE_MS, grace_ms=STALE_MS)

    def run():
        finish(jobs.start_profile(
            guard_triggers(source(spark, folder)), cache, str(tmp_path / "cp"), rules,
            event_time=True, delay="1 second", topic_format="parquet",
            topic_options={"path": topics}, **ONCE))

    cut = [low, low + (high - low) // 3, low + 2 * (high - low) // 3, high + 1]
    for start, end in zip(cut[:2], cut[1:]):
        feed(events.filter(F.col("timestamp").between(start, end - 1)), folder)
    run()
    feed(events.filter(F.col("timestamp") >= cut[2]), folder)
    feed(sentinel(spark, horizon + 1000), folder)
    run()

    def sent(topic):
        return texts(spark.read.parquet(f"{topics}/{topic}"))

    forms = A.with_player(A.stale_forms(events, horizon, STALE_MS, STALE_MS, 4, 2), events)
    assert sent(C.PARAMS_TOPIC) == texts(to_messages(forms, C.FORM_MESSAGE))
    changed = A.with_player(A.prediction_updates(events), events)
    assert sent(C.PREDICTIONS_TOPIC) == texts(to_messages(changed, C.PREDICTION_MESSAGE))
    begun = guard_triggers(events.filter(F.col("event_type") == C.ENCOUNTER))
    assert sent(C.TRIGGERS_TOPIC) == texts(to_messages(begun, C.TRIGGERS_TOPIC))
    columns = ["run_id", "event_id", "player_id", "encounterId", *S.TOTALS, "avg_hp_percent",
               "upgrade_counts"]
    cached = shown(tables.read_features(spark, cache).select(columns))
    batch = shown(R.latest(S.snapshots(events), "run_id", "timestamp", "event_id").select(columns))
    assert sorted(map(str, cached.collect())) == sorted(map(str, batch.collect()))
    compacted = str(tmp_path / "compacted")
    tables.compact_features(spark, cache, compacted)
    again = shown(tables.read_features(spark, compacted).select(columns))
    assert sorted(map(str, again.collect())) == sorted(map(str, cached.collect()))


def literal_forms(kills, stale, grace, horizon):
    """Form messages of one run, kill by kill, each with a mean of its own cosine."""
    form, stale_at, ignore_until, sent = C.SKIRMISHER, None, 0, []
    other = {C.SKIRMISHER: C.JUGGERNAUT, C.JUGGERNAUT: C.SKIRMISHER}
    for moment, cosine in [*kills, (horizon, None)]:
        while stale_at is not None and stale_at <= moment:
            form, ignore_until = other[form], stale_at + grace
            sent.append((stale_at, form))
            stale_at += stale
        if cosine is None or moment < ignore_until:
            continue
        new = C.JUGGERNAUT if cosine < -0.2 else C.SKIRMISHER if cosine > 0.6 else other[form]
        if new != form:
            form, stale_at = new, moment + stale
            sent.append((moment, form))
    return sent


@pytest.mark.parametrize("grace", [5000, 2000, 0])
def test_stale_timers(spark, flat, tmp_path, grace):
    """Cancelled and re-armed timers, and kills ignored for the grace time."""
    draw = random.Random(grace)
    angles = {-1.0: (-1.0, 0.0), 0.0: (0.0, 1.0), 1.0: (1.0, 0.0)}
    kills = [(1000 + 700 * at + draw.randrange(600) + 6000 * (at // 8), draw.choice(list(angles)))
             for at in range(40)]
    events = flat({"event_type": C.MOVEMENT, "timestamp": 500, "x": 1.0, "y": 0.0}, *[
        {"event_type": C.KILL, "timestamp": at, "x": angles[c][0], "y": angles[c][1]}
        for at, c in kills])
    horizon = kills[-1][0] + 12_000
    folder = str(tmp_path / "in")
    feed(events.filter(F.col("timestamp") < 20_000), folder)
    feed(events.filter(F.col("timestamp") >= 20_000), folder)
    feed(sentinel(spark, horizon + 1000), folder)
    rules = P.Rules(kill_history=1, kill_min=1, grace_ms=grace)
    rows = P.profile_stream(source(spark, folder), rules, True, "1 second")
    finish(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
    out = spark.read.schema(P.OUTPUT).parquet(str(tmp_path / "out"))
    assert sorted(values(P.forms_of(out), "timestamp", "form")) == literal_forms(
        kills, 5000, grace, horizon)


def test_processing_time_clock(spark, flat, tmp_path):
    """With the clock of the machine a prediction comes two seconds after the first dash."""
    folder = str(tmp_path / "in")
    feed(flat({"event_type": C.DASH, "x": 1.0, "y": 0.0}), folder)
    rows = P.predictions_of(P.profile_stream(source(spark, folder), P.Rules(idle_ms=3_600_000)))
    query = rows.writeStream.format("memory").queryName("predictions").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            found = values(spark.table("predictions"), "run_id", "prediction")
            if found:
                break
    finally:
        query.stop()
    assert found == [("r", "right")]


def test_idle_runs_end(spark, flat, tmp_path):
    """Messages stop and state goes after the idle time; a later event begins the run anew."""
    folder, checkpoint, out = (str(tmp_path / name) for name in ("in", "cp", "out"))
    rules = P.Rules(kill_history=1, kill_min=1, idle_ms=12_000)

    def run():
        rows = P.profile_stream(source(spark, folder), rules, True, "1 second")
        finish(rows.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint).trigger(**ONCE).start())

    def stored():
        state = spark.read.format("statestore").option("stateVarName", "profile").load(checkpoint)
        return {row[0] for row in state.select("key.run_id").collect()}

    feed(flat({"event_type": C.DASH, "timestamp": 1000, "x": 1.0, "y": 0.0},
              {"event_type": C.MOVEMENT, "timestamp": 1500, "x": 1.0, "y": 0.0},
              {"event_type": C.KILL, "timestamp": 2000, "x": -1.0, "y": 0.0}), folder)
    feed(sentinel(spark, 100_000), folder)
    run()
    found = spark.read.schema(P.OUTPUT).parquet(out)
    assert sorted(values(P.forms_of(found), "timestamp")) == [(2000,), (7000,), (12_000,)]
    assert values(P.predictions_of(found), "timestamp", "prediction") == [(3000, "right")]
    assert stored() == {"sentinel"}

    # One batch holds the end of a run and its new beginning: no timer has to fire in between.
    feed(flat({"event_type": C.DASH, "timestamp": 110_000, "x": 1.0, "y": 0.0},
              {"event_type": C.ENCOUNTER, "timestamp": 111_000, "boss_archetype": "melee"},
              {"event_type": C.ENCOUNTER, "timestamp": 150_000, "boss_archetype": "melee"}), folder)
    run()
    taken = P.snapshots_of(spark.read.schema(P.OUTPUT).parquet(out))
    assert sorted(values(taken, "timestamp", "total_dashes")) == [(111_000, 1), (150_000, 0)]


def test_fights_without_features_are_tried_again(spark, tmp_path):
    cache, lake, training, folder, side = (
        str(tmp_path / name) for name in ("cache", "lake", "training", "in", "side"))
    taken = S.snapshots(gameplay_events(spark, SMALL))
    first, second = [row[0] for row in taken.select("run_id").distinct().orderBy("run_id").limit(
        2).collect()]
    tables.ensure_tables(spark, training)

    def fight(run):
        rows = [(json.dumps({"event_type": C.BOSS_DONE, "run_id": run, "timestamp": 1, "payload": {
            "boss_archetype": "melee", "win": "true", "encounter_id": run}}),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(folder)
        time.sleep(1.1)
        finish(jobs.start_enrichment(
            decode_fights(read_events(spark, "text", path=folder)), cache, lake, training,
            str(tmp_path / "cp"), unmatched=side, max_tries=2, **ONCE))
        return read_lake(spark, lake).count()

    def given_up():
        return sorted(row["run_id"] for row in read_lake(
            spark, f"{side}/given_up", WAITING_FIGHT).collect())

    tables.upsert_latest(taken.filter(F.col("run_id") == first), cache, "0")
    assert fight(second) == 0 and given_up() == []
    tables.upsert_latest(taken.filter(F.col("run_id") == second), cache, "1")
    assert fight("nobody") == 1
    assert tables.read_training(spark, training).count() == 10
    assert fight(first) == 2 and given_up() == ["nobody"]
    assert fight(first) == 3 and given_up() == ["nobody"]


def test_trained_weights_answer_triggers(spark, tmp_path):
    """From stored training rows to a worded offer; an archetype without rows keeps its model."""
    cache, training, weights, folder, topics = (
        str(tmp_path / name) for name in ("cache", "training", "weights", "in", "topics"))
    events = gameplay_events(spark, SMALL)
    taken = S.snapshots(events)
    tables.upsert_latest(taken, cache, "all")
    records = R.training_records(events)
    tables.append_training(R.oversampled_fights(records), training, "a")
    jobs.run_training(spark, training, weights)

    def stored():
        return spark.read.schema(M.WEIGHTS).parquet(weights).select(M.WEIGHTS.fieldNames())

    known = {row[0] for row in records.select("boss_archetype").distinct().collect()}
    before = sorted(map(tuple, stored().collect()))
    assert {row[0] for row in before} == known
    kept = sorted(known)[0]
    alone = str(tmp_path / "alone")
    tables.append_training(records.filter(F.col("boss_archetype") == kept), alone, "a")
    jobs.run_training(spark, alone, weights)
    again = sorted(map(tuple, stored().collect()))
    assert [row for row in again if row[0] != kept] == [row for row in before if row[0] != kept]

    run = taken.agg(F.min("run_id")).first()[0]
    asked = {"run_id": run, "encounter_id": "a", "boss_archetype": kept, "reply": "{}"}
    spark.createDataFrame([(json.dumps(asked),)], "value string").coalesce(1).write.text(folder)
    finish(jobs.start_offers(read_events(spark, "text", path=folder), cache, weights,
                             str(tmp_path / "cp"), "parquet", {"path": topics}, **ONCE))
    sent = [json.loads(json.loads(value)["payload"])
            for value in texts(spark.read.parquet(f"{topics}/{C.RESULTS_TOPIC}"))]
    assert [row["dialogue"] for row in sent] == [C.REPLY_DIALOGUE]


def test_enrichment_and_bootstrap(spark, tmp_path):
    """Fights become training rows and lake records once, however often a batch is tried."""
    events, records = gameplay_events(spark, SMALL), gameplay_records(spark, SMALL)
    cache, lake, training, folder = (
        str(tmp_path / name) for name in ("cache", "lake", "training", "in"))
    tables.upsert_latest(S.snapshots(events), cache, "all")
    records.select("value").coalesce(1).write.text(folder)

    def enrich(checkpoint):
        fights = decode_fights(read_events(spark, "text", path=folder))
        finish(jobs.start_enrichment(fights, cache, lake, training, checkpoint, **ONCE))

    tables.ensure_tables(spark, training)
    assert tables.read_training(spark, training).count() == 0
    enrich(str(tmp_path / "cp"))
    joined = R.enrich(S.fights(events), tables.read_features(spark, cache))
    expected = R.enriched_view(joined)
    bosses = R.split_type(expected)[1].count()
    want = expected.count() + 9 * bosses
    assert tables.read_training(spark, training).count() == want
    assert read_lake(spark, lake).count() == bosses
    enrich(str(tmp_path / "cp"))
    assert tables.read_training(spark, training).count() == want

    starts = str(tmp_path / "starts")
    rows = [(json.dumps({"event_type": C.SESSION_START}),), ('{"event_type":"other"}',)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(starts)
    for checkpoint in ("cp1", "cp2"):
        finish(jobs.start_bootstrap(
            read_events(spark, "text", path=starts), lake, training, str(tmp_path / "markers"),
            str(tmp_path / checkpoint), **ONCE))
    assert read_lake(spark, lake).count() == bosses + 6
    rebuilt = tables.read_training(spark, training)
    assert rebuilt.count() == 10 * bosses + 24
    assert rebuilt.filter("boss_archetype = 'final'").count() >= 20


def test_offers_on_triggers(spark, tmp_path):
    """A model answers its archetype; a missing model or reply gives the fallback."""
    cache, weights, folder, topics = (
        str(tmp_path / name) for name in ("cache", "weights", "in", "topics"))
    taken = S.snapshots(gameplay_events(spark, SMALL))
    tables.upsert_latest(taken, cache, "all")
    run = taken.agg(F.min("run_id")).first()[0]
    spark.createDataFrame([("melee", "total_dashes", 1.0, -1000.0, 1.0, 0.0)], M.WEIGHTS
                          ).write.parquet(weights)
    asked = [{"run_id": run, "encounter_id": "a", "reply": "{}"},
             {"run_id": run, "encounter_id": "b", "boss_archetype": "final", "reply": "{}"},
             {"run_id": run, "encounter_id": "c"}, {"run_id": "nobody", "encounter_id": "d"},
             {"run_id": run}]
    spark.createDataFrame([(json.dumps(row),) for row in asked], "value string").coalesce(
        1).write.text(folder)
    finish(jobs.start_offers(read_events(spark, "text", path=folder), cache, weights,
                             str(tmp_path / "cp"), "parquet", {"path": topics}, **ONCE))
    sent = [json.loads(json.loads(value)["payload"])
            for value in texts(spark.read.parquet(f"{topics}/{C.RESULTS_TOPIC}"))]
    dialogue = {row["encounterId"]: row["dialogue"] for row in sent}
    assert dialogue == {"a": C.REPLY_DIALOGUE, "b": C.FALLBACK_DIALOGUE, "c": C.FALLBACK_DIALOGUE}
    assert all(len(row["choices"]) == 2 and row["playerId"].startswith("player") for row in sent)
    won = next(row for row in sent if row["encounterId"] == "a")
    assert won["choices"][0]["debuffs"] and not won["choices"][0]["buffs"]


def test_landing(spark, tmp_path):
    records = gameplay_records(spark, SMALL)
    folder, landed = str(tmp_path / "in"), str(tmp_path / "landed")
    records.select("value").coalesce(1).write.text(folder)
    stream = read_events(spark, "text", path=folder).withColumn(
        "record_time", F.timestamp_millis(F.get_json_object("value", "$.timestamp").cast("long")))
    finish(tables.land_raw(stream, landed, str(tmp_path / "cp"), **ONCE))
    found = read_landed(spark, landed)
    assert found.count() == records.count()
    assert {"dt", "event_type", "payload"} <= set(found.columns)


def test_seeding_twice_adds_nothing(spark, tmp_path):
    lake, training = str(tmp_path / "lake"), str(tmp_path / "training")
    assert read_lake(spark, lake).isEmpty() and read_lake(spark, lake).columns
    assert tables.seed_if_absent(spark, lake) == 6
    assert tables.seed_if_absent(spark, lake) == 0
    shown_only = jobs.run_bootstrap(spark, lake, training, dry_run=True)
    assert shown_only.count() == 24 and not (tmp_path / "training").exists()
    jobs.run_bootstrap(spark, lake, training)
    counts = {row[0]: row[1] for row in tables.read_training(spark, training).groupBy(
        "boss_archetype").count().collect()}
    assert counts == {"melee": 2, "ranged": 2, "final": 20}
    assert tables.table_names()["melee"] == "melee_training_data"
    one = tables.read_training(spark, training, "final")
    assert one.select("outcome").distinct().count() == 2


def test_batch_written_again_replaces_itself(spark, tmp_path):
    events = gameplay_events(spark, SMALL)
    records = R.training_records(events)
    path = str(tmp_path / "training")
    for batch in ("a-0", "a-0", "b-0"):
        tables.append_training(records, path, batch)
    assert tables.read_training(spark, path).count() == 2 * records.count()


def test_session_starts(spark):
    frame = spark.createDataFrame([('{"event_type":"play_session_started"}',), ("junk",)],
                                  "value string")
    assert jobs.session_starts(frame).schema == SESSION_EVENT
    assert jobs.session_starts(frame).count() == 1
