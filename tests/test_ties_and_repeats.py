"""Equal times, events delivered twice, and runs whose player changes."""

from conftest import values
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.operators import features as E
from runlens.operators import snapshots as S
from runlens.sources.events import delivered_once, record_id

BOSS = {"boss_archetype": "melee", "win": True}


def test_fight_finds_a_snapshot_of_its_own_time(flat):
    events = flat(
        {"event_type": C.BOSS_DONE, "timestamp": 5, "event_id": 1, **BOSS},
        {"event_type": C.ENCOUNTER, "timestamp": 5, "event_id": 2, **BOSS},
        {"event_type": C.BOSS_DONE, "timestamp": 4, "event_id": 3, **BOSS})
    wanted = [(1, 2)]
    assert values(S.fights_with_features(events), "event_id", "snapshot_id") == wanted
    found = S.asof_features(S.fights(events), S.snapshots(events, upgrades=False))
    assert values(found, "event_id", "snapshot_id") == wanted
    assert values(S.unmatched_fights(events), "event_id") == [(3,)]


def test_elite_fight_has_its_own_snapshot(flat):
    events = flat(
        {"event_type": C.ELITE_DONE, "timestamp": 5, "event_id": 1, **BOSS},
        {"event_type": C.ENCOUNTER, "timestamp": 5, "event_id": 2, **BOSS})
    found = S.asof_features(S.fights(events), S.snapshots(events, upgrades=False))
    for rows in (S.fights_with_features(events), found):
        assert values(rows, "event_id", "snapshot_id") == [(1, 1)]


def test_matched_and_unmatched_are_all_fights(flat):
    events = flat(*[{"event_type": kind, "timestamp": at // 3, "event_id": at, "run_id": f"r{at % 2}",
                     **BOSS} for at, kind in enumerate(
                         [C.BOSS_DONE, C.BOSS_DONE, C.ENCOUNTER, C.BOSS_DONE, C.ELITE_DONE] * 6)])
    matched, rest = S.fights_with_features(events), S.unmatched_fights(events)
    found = matched.select("event_id").unionByName(rest.select("event_id"))
    assert sorted(values(found, "event_id")) == sorted(values(S.fights(events), "event_id"))


def test_trigger_delivered_twice_does_not_fail(flat):
    upgrade = {"event_type": C.UPGRADE, "timestamp": 1, "event_id": 1, "chosen_upgrade_id": "a"}
    trigger = {"event_type": C.ENCOUNTER, "timestamp": 2, "event_id": 2, **BOSS}
    events = flat(upgrade, trigger, trigger)
    assert values(S.running_upgrades(events), "event_id", "upgrade_counts") == [(2, {"a": 1})]
    assert delivered_once(events).count() == 2


def test_ids_of_partitions_differ(spark):
    rows = spark.range(3).select(record_id(F.col("id"), F.lit(7).cast("long")).alias("id"))
    assert len({row.id for row in rows.collect()}) == 3


def test_one_first_player(flat):
    events = flat(
        {"event_type": C.BOSS_DONE, "player_id": "boss", **BOSS},
        {"event_type": C.ENCOUNTER, "player_id": "guarded"},
        {"event_type": C.DASH, "player_id": None},
        {"event_type": C.STATUS, "player_id": "second", "timestamp": 9_000, "event_id": 8},
        {"event_type": C.STATUS, "player_id": "first", "timestamp": 9_000, "event_id": 7},
        {"event_type": C.ENCOUNTER, "timestamp": 10_000, "event_id": 9, **BOSS},
        {"event_type": C.BOSS_DONE, "timestamp": 11_000, "event_id": 10, **BOSS})
    for rows in (E.run_player(events), E.feature_vectors(events), S.snapshots(events),
                 S.fights_with_features(events)):
        assert values(rows, "player_id") == [("first",)]


def test_choices_without_an_upgrade_count_nowhere(spark, flat):
    events = flat({"event_type": C.UPGRADE, "chosen_upgrade_id": None},
                  {"event_type": C.UPGRADE, "chosen_upgrade_id": "a"},
                  {"event_type": C.ENCOUNTER, "boss_archetype": "melee"})
    assert values(E.upgrade_counts(events), "upgrade_counts") == [({"a": 1},)]
    assert values(E.feature_vectors(events), "upgrade_counts") == [({"a": 1},)]
    assert values(S.snapshots(events), "upgrade_counts") == [({"a": 1},)]
