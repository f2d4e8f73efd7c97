"""The as-of join with its state by parts of the runs, and what its job feeds and writes."""

from pathlib import Path

from conftest import values
from test_asof_and_ingest import ONCE, Feeds, finish

from runlens import constants as C
from runlens.sinks import tables
from runlens.sources.tables import read_lake
from runlens.streaming import asof, replay
from runlens.streaming.jobs import audit_counts, start_asof_enrichment


def test_runs_of_one_part_keep_apart(spark, tmp_path):
    """Two parts for all runs: ties, late and expired fights, a restart, a run without a name."""
    feeds, out = Feeds(spark, tmp_path), str(tmp_path / "out")
    boss, elite = C.BOSS_DONE, C.ELITE_DONE

    def run():
        found = asof.asof_stream(*feeds.streams(), "1 second", idle_ms=None, parts=2)
        finish(found.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        return sorted(values(spark.read.schema(asof.OUTPUT).parquet(out), "event_id", "run_id",
                             "status", "snapshot_id", "upgrades"))

    feeds.put_fights(("a", 5000, 50, boss), ("a", 1000, 10, boss), ("b", 5000, 51, elite),
                     (None, 5000, 53, boss))
    feeds.put_shots(("a", 4000, 40), ("a", 2000, 20), (None, 3000, 30))
    assert run() == [(10, "a", "expired", None, None)]
    feeds.put_shots(("a", 5000, 60), ("b", 5000, 51), ("b", 5000, 52), ("a", 9000, 90))
    feeds.put_fights(("a", 20_000, 100, boss), ("c", 20_000, 101, elite), ("a", 30_000, 102, boss),
                     (None, None, None, None))
    run()
    feeds.put_shots(("z", 25_000, 800))
    feeds.put_fights((None, 25_000, None, None))
    run()
    feeds.put_shots(("z", 40_000, 900))
    feeds.put_fights((None, 40_000, None, None))
    up = '{"u":2}'
    assert run() == [
        (10, "a", "expired", None, None), (50, "a", "matched", 60, up),
        (51, "b", "matched", 51, up), (53, None, "matched", 30, up),
        (100, "a", "matched", 90, up), (101, "c", "expired", None, None),
        (102, "a", "matched", 90, up)]
    state = spark.read.format("statestore").option("stateVarName", "shots").load(
        str(tmp_path / "cp"))
    assert {row[0] for row in state.select("key.part").collect()} <= {0, 1}
    # Of the snapshots that are passed only the newest of a run stays.
    held = state.selectExpr("explode(from_json(list_element.rows, 'array<array<string>>')) r")
    assert sorted((row[0][0] or "", row[0][2]) for row in held.collect()) == [
        ("", "30"), ("a", "90"), ("b", "52"), ("z", "800"), ("z", "900")]


def test_idle_snapshots_of_a_part_go(spark, tmp_path):
    feeds, out = Feeds(spark, tmp_path), str(tmp_path / "out")
    feeds.put_shots(("a", 1000, 1), ("b", 50_000, 2))
    feeds.put_fights(("b", 50_000, 3, C.BOSS_DONE))

    def run():
        found = asof.asof_stream(*feeds.streams(), "1 second", idle_ms=10_000, parts=1)
        finish(found.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        return sorted(values(spark.read.schema(asof.OUTPUT).parquet(out), "event_id", "status"))

    run()
    feeds.put_fights(("a", 55_000, 4, C.BOSS_DONE), ("z", 90_000, 5, C.BOSS_DONE))
    feeds.put_shots(("y", 90_000, 6))
    assert run() == [(3, "matched"), (4, "expired")]


def test_a_batch_writes_as_few_files_as_it_needs(spark, tmp_path):
    feeds, side, training, lake = Feeds(spark, tmp_path), *(
        str(tmp_path / name) for name in ("side", "training", "lake"))
    feeds.put_shots(*[(f"r{n}", 1000, n) for n in range(40)], ("z", 90_000, 99))
    feeds.put_fights(*[(f"r{n}", 2000, 100 + n, C.BOSS_DONE) for n in range(40)],
                     ("z", 90_000, 999, C.ELITE_DONE))
    tables.ensure_tables(spark, training)
    finish(start_asof_enrichment(*feeds.streams(), lake, training, side, str(tmp_path / "cp"),
                                 "1 second", parts=8, **ONCE))
    assert tables.read_training(spark, training).count() == 40 * C.OVERSAMPLE
    assert read_lake(spark, lake).count() == 40
    counts = audit_counts(spark, side).orderBy("loaded").drop("batch").collect()
    assert [row.loaded for row in counts] == [0, 40]  # the batch without matches is counted too
    assert [row.oversampled for row in counts] == [0, 40 * C.OVERSAMPLE]
    for folder in (training, lake):
        assert len([*Path(folder).glob("boss_archetype=*/batch=*/part-*")]) == 1


def test_a_turn_is_fed_by_one_write(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(n, n, 0.5) for n in range(4)], "timestamp long, slice int, x double")
    others = spark.createDataFrame([(n, n, "u") for n in range(4)],
                                   "timestamp long, slice int, name string")
    feeds = replay.side_by_side([rows, others], str(tmp_path / "fed"))
    replay.put_turn(feeds, 0)
    monkeypatch.setattr(replay, "feed", None)  # from now on no feed is written alone
    for turn in range(1, 5):
        replay.put_turn(feeds, turn)
    for fed, row in zip(feeds, ((0, 0.5), (0, "u"))):
        assert fed.watched().columns == [name for name in fed.rows.columns if name != "slice"]
        found = spark.read.schema(fed.watched().schema).parquet(fed.folder)
        assert sorted(map(tuple, found.collect())) == [(n, row[1]) for n in range(4)]
