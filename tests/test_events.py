"""Decoding, per-run rules and histories on literal events."""

import json
import random

import pytest
from conftest import values
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.operators import adaptation as A
from runlens.operators import features as E
from runlens.operators import snapshots as S
from runlens.operators import training as R
from runlens.sources import events as X


def record(kind="x", run="r", **payload):
    return json.dumps({"event_type": kind, "timestamp": 5, "player_id": "p", "run_id": run,
                       "payload": payload})


def test_bad_records_are_quarantined(spark):
    bad = ["", "null", "junk", "[1]", '{"event_type":"x"}', '{"run_id":"r"}',
           '{"event_type":"x","run_id":"r","timestamp":"soon"}',
           '{"event_type":"x","run_id":"r","payload":5}']
    frame = spark.createDataFrame([(text,) for text in [*bad, record()]], "value string")
    good, quarantine = X.split_valid(frame)
    assert good.count() == 1 and {row[0] for row in quarantine.collect()} == set(bad)


def test_defaults_and_unusable_vectors(spark):
    texts = [
        record(C.STATUS, hp=3), record(C.DAMAGE_TAKEN, dmg_amount="x", is_elite_source="TRUE"),
        record(C.UPGRADE), record(C.DASH), record(C.DASH, direction=4),
        record(C.DASH, direction={"dx": 2}), record(C.MOVEMENT, dir={"dx": "a"}),
        record(C.ELITE_DONE, boss_archetype="Final", win="true"),
    ]
    frame = spark.createDataFrame([(text,) for text in texts], "value string")
    flat = X.flatten_payload(X.split_valid(frame)[0])
    rows = {row["event_type"]: row for row in flat.collect()}
    assert flat.count() == 5 and C.MOVEMENT not in rows
    assert (rows[C.STATUS]["hp"], rows[C.STATUS]["max_hp"]) == (3.0, 1.0)
    assert rows[C.DAMAGE_TAKEN]["dmg_amount"] == 0.0 and rows[C.DAMAGE_TAKEN]["is_elite_source"]
    assert rows[C.UPGRADE]["chosen_upgrade_id"] == C.DEFAULT_UPGRADE
    assert (rows[C.DASH]["x"], rows[C.DASH]["y"]) == (2.0, 0.0)
    assert rows[C.ELITE_DONE]["boss_archetype"] == "final" and rows[C.ELITE_DONE]["win"]


def test_trigger_without_archetype_has_no_effect(flat):
    events = flat(
        {"event_type": C.ENCOUNTER, "boss_archetype": None, "player_id": "ghost"},
        {"event_type": C.ENCOUNTER, "boss_archetype": "none"},
        {"event_type": C.ELITE_DONE, "boss_archetype": "melee", "encounter_id": "e"})
    assert values(S.snapshots(events), "event_id", "player_id", "avg_hp_percent") == [
        (2, "p", 1.0)]
    assert values(E.feature_vectors(events), "player_id") == [("p",)]


def test_histories_end_at_their_length(flat):
    """The 101st reading, the 21st kill and the 11th dash push out the oldest."""
    hp = [{"event_type": C.STATUS, "hp": float(i == 0), "max_hp": 1.0} for i in range(101)]
    events = flat(*hp, {"event_type": C.STATUS, "hp": 1.0, "max_hp": 0.0})
    assert values(E.avg_hp(events), "avg_hp_percent") == [(0.0,)]
    assert values(E.avg_hp(events, 101), "avg_hp_percent") == [(1 / 101,)]
    kills = [{"event_type": C.KILL, "x": -1.0 if i == 0 else 1.0, "y": 0.0} for i in range(21)]
    found = values(A.kill_alignment(flat(
        {"event_type": C.MOVEMENT, "x": 1.0, "y": 0.0}, *kills)), "alignment")
    assert found[3] == (None,) and found[4] == (0.6,) and found[19] == (0.9,)
    assert found[20] == (1.0,)
    dashes = [(1.0, 0.0)] * 6 + [(0.0, 1.0)] * 5
    found = values(A.dash_mode(flat(*[
        {"event_type": C.DASH, "x": x, "y": y} for x, y in dashes])), "prediction")
    assert found[9] == ("right",) and found[10] == ("up",)


def test_mode_ties_go_to_the_latest(flat):
    dashes = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    found = values(A.dash_mode(flat(*[
        {"event_type": C.DASH, "x": float(x), "y": float(y)} for x, y in dashes])), "prediction")
    assert found == [("right",), ("left",), ("up",), ("down",)]


def test_forms_at_the_thresholds(flat):
    """Means of exactly -0.2 and 0.6 flip; a kill without a cosine flips as well."""
    def kills(*xs):
        return [{"event_type": C.KILL, "x": float(x), "y": float(not x)} for x in xs]

    move = {"event_type": C.MOVEMENT, "x": 1.0, "y": 0.0}
    assert values(A.brute_forms(flat(move, *kills(-1, 0, 0, 0, 0))), "form")[-1] == (C.JUGGERNAUT,)
    assert values(A.brute_forms(flat(move, *kills(1, 1, 1, 0, 0))), "form")[-1] == (C.JUGGERNAUT,)
    assert values(A.brute_forms(flat(move, *kills(1, 1, 1, 1, 0))), "form")[-1] == (C.SKIRMISHER,)
    still = {"event_type": C.KILL, "x": 0.0, "y": 0.0}
    found = values(A.brute_forms(flat(move, *kills(1, 1, 1, 0, 0), still, still)), "form")
    assert [form for form, in found[-3:]] == [C.JUGGERNAUT, C.SKIRMISHER, C.JUGGERNAUT]
    assert values(A.brute_forms(flat(*kills(*[1] * 6))), "form") == [(C.SKIRMISHER,)] * 6


def loop(decisions):
    form, forms = C.SKIRMISHER, []
    for decision in decisions:
        form = {"keep": form, "flip": A_OTHER[form]}.get(decision, decision)
        forms.append(form)
    return forms


A_OTHER = {C.SKIRMISHER: C.JUGGERNAUT, C.JUGGERNAUT: C.SKIRMISHER}


@pytest.mark.parametrize("limit", [10_000, 7])
def test_form_scan_equals_a_loop(spark, run_limit, limit):
    from runlens.operators.runs import by_run

    draw = random.Random(3)
    means = {"keep": None, "flip": 0.1, C.JUGGERNAUT: -0.9, C.SKIRMISHER: 0.9}
    runs = {f"r{n}": draw.choices(list(means), [2, 5, 1, 1], k=40) for n in range(6)}
    rows = [(run, at, at, means[decision]) for run, decisions in runs.items()
            for at, decision in enumerate(decisions)]
    run_limit(limit)
    frame = spark.createDataFrame(rows, "run_id string, timestamp long, event_id long, "
                                  "alignment double")
    found = by_run(frame, lambda part: A._forms(part).result("run_id", "event_id", "form"))
    by_name = {(row["run_id"], row["event_id"]): row["form"] for row in found.collect()}
    for run, decisions in runs.items():
        assert [by_name[run, at] for at in range(40)] == loop(decisions)


def test_predictions_follow_the_clock_of_the_run(flat):
    """A dash at the moment of a tick counts; a tick that brings no change is silent."""
    dashes = [(0, 1, 0), (2000, 0, 1), (2001, 0, 1), (9000, 0, 1)]
    events = flat(*[{"event_type": C.DASH, "timestamp": at, "x": float(x), "y": float(y)}
                    for at, x, y in dashes])
    assert values(A.prediction_updates(events), "moment", "prediction") == [(2000, "up")]


def test_short_grace_is_left_to_the_stream(flat):
    with pytest.raises(ValueError):
        A.stale_forms(flat({"event_type": C.KILL, "x": 1.0, "y": 1.0}), 10, 5000, 4000)


def test_oversampling_counts(spark):
    rows = spark.createDataFrame([(1.0,), (0.1,), (None,), (2.0,)], "weight double")
    assert R.oversampled_history(rows).count() == 10 + 1 + 10
    light, full = R.split_weight(rows)
    assert light.count() == 1 and full.count() == 2


def test_standardise_without_spread(spark):
    rows = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 9.0, 1.0)],
                                 "boss_archetype string, u double, v double")
    scored = R.standardise(rows, ["u", "v"])
    found = sorted((a, round(u, 6), v) for a, u, v in values(scored, "boss_archetype", "u", "v"))
    assert found == [("a", -0.707107, 0.0), ("a", 0.707107, 0.0), ("b", 0.0, 0.0)]


def test_snapshot_totals_never_fall(spark):
    from conftest import SMALL
    from pyspark.sql import Window
    from runlens.sources.telemetry import gameplay_events

    taken = S.snapshots(gameplay_events(spark, SMALL), upgrades=False)
    order = Window.partitionBy("run_id").orderBy("timestamp", "event_id")
    falls = [F.col(name) < F.lag(name).over(order) for name in S.TOTALS]
    flagged = taken.select(*[fall.alias(f"f{at}") for at, fall in enumerate(falls)])
    assert flagged.filter(" or ".join(flagged.columns)).isEmpty()
