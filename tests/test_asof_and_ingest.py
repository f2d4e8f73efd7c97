"""Point-in-time join in the stream, the ingest job, and state begun from a batch."""

import json
import time

import pytest
from conftest import SMALL, values
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.operators import snapshots as S
from runlens.schemas import FLAT_EVENT
from runlens.sources.events import delivered_once, flatten_payload, split_valid
from runlens.sources.telemetry import gameplay_events
from runlens.streaming import asof, ingest
from runlens.streaming import profile as P
from runlens.streaming.jobs import audit_counts, start_asof_enrichment
from runlens.sinks import tables
from runlens.sources.tables import read_lake

ONCE = {"availableNow": True}


def finish(query):
    try:
        assert query.awaitTermination(240)
    finally:
        query.stop()


def put(frame, folder):
    """One more file, newer than those before it."""
    frame.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


class Feeds:
    """Files of fights and of snapshots, and the columns that tests leave out."""

    def __init__(self, spark, folder):
        self.spark = spark
        self.fights, self.shots = f"{folder}/fights", f"{folder}/shots"
        shot = [f"{field.name} {field.dataType.simpleString()}" for field in asof.SHOT.fields
                if field.name != "upgrades"]
        fight = [f"{field.name} {field.dataType.simpleString()}" for field in asof.FIGHT.fields]
        self.shot = ", ".join(["run_id string", *shot, "upgrade_counts map<string,int>"])
        self.fight = ", ".join(["run_id string", *fight])

    def put_fights(self, *rows):
        put(self.spark.createDataFrame([(run, at, id_, kind, "melee", True)
                                        for run, at, id_, kind in rows], self.fight), self.fights)

    def put_shots(self, *rows):
        put(self.spark.createDataFrame(
            [(run, at, id_, "p", f"e{id_}", 1, 0.0, 0.0, 0.0, 1.0, {"u": 2})
             for run, at, id_ in rows], self.shot), self.shots)

    def streams(self):
        def stream(schema, folder):
            return self.spark.readStream.schema(schema).option(
                "maxFilesPerTrigger", 1).parquet(folder)

        return stream(self.fight, self.fights), stream(self.shot, self.shots)


def test_each_fight_gets_the_snapshot_of_its_time(spark, tmp_path):
    """Fights before their snapshots, ties, late marks, expired ones, and a restart."""
    feeds, out = Feeds(spark, tmp_path), str(tmp_path / "out")

    def run():
        found = asof.asof_stream(*feeds.streams(), "1 second", idle_ms=None)
        finish(found.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        return spark.read.schema(asof.OUTPUT).parquet(out)

    boss, elite = C.BOSS_DONE, C.ELITE_DONE
    feeds.put_fights(("a", 5000, 50, boss), ("a", 1000, 10, boss), ("b", 5000, 51, elite))
    feeds.put_shots(("a", 4000, 40), ("a", 2000, 20))
    # The watermark of the slower input, 3,000, has passed one fight only.
    assert values(run(), "event_id", "status") == [(10, "expired")]
    # At equal times a boss fight comes after all snapshots, an elite fight at its own id.
    feeds.put_shots(("a", 5000, 60), ("b", 5000, 51), ("b", 5000, 52), ("a", 9000, 90))
    feeds.put_fights(("a", 20_000, 100, boss), ("c", 20_000, 101, elite), (None, None, None, None))
    found = run()
    assert sorted(values(found, "event_id", "status", "snapshot_id")) == [
        (10, "expired", None), (50, "matched", 60), (51, "matched", 51)]
    feeds.put_shots(("z", 40_000, 900))
    feeds.put_fights((None, 40_000, None, None))
    found = run()
    assert sorted(values(found, "event_id", "status", "snapshot_id"))[2:] == [
        (51, "matched", 51), (100, "matched", 90), (101, "expired", None)]
    kept = asof.matched(found).filter("event_id = 50").first()
    assert (kept.run_id, kept.encounterId, kept.upgrade_counts) == ("a", "e60", {"u": 2})
    assert values(asof.expired(found).orderBy("event_id"), "run_id", "event_id") == [
        ("a", 10), ("c", 101)]
    # Of the snapshots that are passed only the newest stays.
    state = spark.read.format("statestore").option("stateVarName", "shots").load(
        str(tmp_path / "cp"))
    held = state.select("key.run_id", F.explode(F.array("list_element.event_id")).alias("id"))
    assert sorted(map(tuple, held.filter("run_id in ('a', 'b')").collect())) == [
        ("a", 90), ("b", 52)]


def test_idle_snapshots_go(spark, tmp_path):
    feeds, out = Feeds(spark, tmp_path), str(tmp_path / "out")
    feeds.put_shots(("a", 1000, 1), ("b", 50_000, 2))
    feeds.put_fights(("b", 50_000, 3, C.BOSS_DONE))

    def run():
        found = asof.asof_stream(*feeds.streams(), "1 second", idle_ms=10_000)
        finish(found.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        return sorted(values(spark.read.schema(asof.OUTPUT).parquet(out), "event_id", "status"))

    run()
    feeds.put_fights(("a", 55_000, 4, C.BOSS_DONE), ("z", 90_000, 5, C.BOSS_DONE))
    feeds.put_shots(("y", 90_000, 6))
    assert run() == [(3, "matched"), (4, "expired")]


def test_enrichment_keeps_and_counts_everything(spark, tmp_path):
    feeds, side, training, lake = Feeds(spark, tmp_path), *(
        str(tmp_path / name) for name in ("side", "training", "lake"))
    feeds.put_shots(("a", 1000, 1), ("z", 90_000, 9))
    feeds.put_fights(("a", 2000, 2, C.BOSS_DONE), ("a", 3000, 3, C.ELITE_DONE),
                     ("b", 2000, 4, C.BOSS_DONE), ("z", 90_000, 9, C.ELITE_DONE))
    tables.ensure_tables(spark, training)
    for checkpoint in ("cp", "cp"):
        finish(start_asof_enrichment(*feeds.streams(), lake, training, side,
                                     str(tmp_path / checkpoint), "1 second", **ONCE))
    assert tables.read_training(spark, training).count() == 11
    assert values(read_lake(spark, lake), "run_id", "encounterId") == [("a", "e1")]
    sums = audit_counts(spark, side).agg(*[F.sum(name) for name in (
        "loaded", "enriched", "expired", "oversampled", "persisted")]).first()
    assert tuple(sums) == (3, 2, 1, 11, 1)
    assert spark.read.json(f"{side}/expired").select("run_id").collect() == [("b",)]


# --- ingest --------------------------------------------------------------------------------------

def record(event_id, at, kind=C.DASH, run="r", **payload):
    return event_id, json.dumps({"event_type": kind, "timestamp": at, "player_id": "p",
                                 "run_id": run, "payload": payload})


@pytest.fixture
def ingested(spark, tmp_path):
    path = str(tmp_path / "store")

    def turn(number, *rows, schema="event_id long, value string"):
        ingest.ingest_batch(spark.createDataFrame(list(rows), schema), path, f"q-{number}", 5000)
        stored = ingest.read_records(spark, path)
        return sorted(values(stored.filter(F.col("batch") == f"q-{number}"), "event_id", "status"))

    return path, turn


def test_every_record_has_one_status(spark, ingested):
    path, turn = ingested
    dash = {"direction": {"dx": 1, "dy": 0}, "combo": 3}
    assert turn(0, record(1, 1000, **dash), record(1, 1000, **dash), (2, "junk"), (3, ""),
                (4, None), record(5, 100_000, **dash)) == [
        (1, "good"), (1, "repeated"), (2, "quarantined"), (3, "quarantined"),
        (4, "quarantined"), (5, "good")]
    # The watermark is 95,000: what is behind it is late, what came before is repeated.
    # A batch that is tried again reads the same watermark and replaces its rows.
    for _ in range(2):
        assert turn(1, record(1, 1000, **dash), record(5, 100_000, **dash),
                    record(6, 95_000, **dash), record(7, 94_999, **dash)) == [
            (1, "late"), (5, "repeated"), (6, "good"), (7, "late")]
    counts = ingest.ingest_counts(spark, path).orderBy("number")
    assert [tuple(row)[:5] for row in counts.collect()] == [
        (95_000, 2, 3, 0, 1), (95_000, 1, 0, 2, 1)]
    good = ingest.read_records(spark, path, ingest.GOOD)
    assert values(good.filter("event_id = 6").select(F.variant_get("payload", "$.combo", "int")
                                                     .alias("combo"), "x", "value"),
                  "combo", "x", "value") == [(3, 1.0, None)]
    bad = ingest.read_records(spark, path, ingest.QUARANTINED)
    assert sorted(values(bad, "event_id", "value"), key=str) == [
        (2, "junk"), (3, ""), (4, None)]
    assert sorted(values(ingest.read_good(spark, path, streaming=False), "event_id")) == [
        (1,), (5,), (6,)]


def test_records_without_an_id_are_known_by_their_text(ingested):
    _, turn = ingested
    rows = [(value,) for _, value in (record(0, 1000, hp=1), record(0, 1000, hp=2),
                                      record(0, 1000, hp=1))]
    assert [status for _, status in turn(0, *rows, schema="value string")].count("good") == 2
    assert {status for _, status in turn(1, *rows, schema="value string")} == {"repeated"}


def test_an_empty_batch_keeps_the_watermark(spark, ingested):
    path, turn = ingested
    turn(0, record(1, 10_000))
    assert turn(1) == []
    assert ingest.mark_before(spark, path, "q-2") == 5000
    assert turn(2, record(2, 4999)) == [(2, "late")]


def test_ingest_reads_the_records_once(spark, tmp_path):
    (tmp_path / "in.txt").write_text(record(1, 1000)[1])
    rows = spark.read.text(str(tmp_path / "in.txt"))
    plan = ingest.judged(rows, 5, spark.createDataFrame([], ingest.INGESTED))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("FileScan text") == 1


def test_repeated_deliveries_count_once(spark):
    rows = [record(1, 1000, direction={"dx": 1, "dy": 0}), record(2, 2000, C.ENCOUNTER,
                                                                boss_archetype="melee")]
    records = spark.createDataFrame(rows * 2, "event_id long, value string")
    flat = flatten_payload(split_valid(records, ("event_id",))[0])
    assert values(S.snapshots(flat), "event_id", "total_dashes") == [(2, 1)]
    assert flat.count() == delivered_once(flat).count() == 2


# --- state begun from a batch --------------------------------------------------------------------

def test_a_stream_goes_on_from_the_state_of_a_batch(spark, tmp_path):
    events = gameplay_events(spark, SMALL).select(*FLAT_EVENT.fieldNames())
    middle = events.agg(F.percentile_approx("timestamp", 0.5)).first()[0]
    past, rest = events.filter(F.col("timestamp") < middle), events.filter(
        F.col("timestamp") >= middle)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(rest, folder)
    initial = P.initial_profiles(past)
    initial.write.parquet(str(tmp_path / "initial"))
    stream = spark.readStream.schema(FLAT_EVENT).parquet(folder)
    output = P.profile_stream(P.guard_triggers(stream), P.Rules(), True, "0 seconds",
                              spark.read.parquet(str(tmp_path / "initial")))
    finish(output.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
    columns = ["event_id", "player_id", "total_dashes", "upgrade_counts", "avg_hp_percent"]
    found = P.snapshots_of(spark.read.schema(P.OUTPUT).parquet(out)).select(columns)
    whole = S.snapshots(events).filter(F.col("timestamp") >= middle).select(columns)

    def shown(frame):
        return sorted((row[0], row[1], row[2], sorted(row[3].items()), round(row[4], 9))
                      for row in frame.collect())

    assert shown(found) == shown(whole) and found.count() > 20
