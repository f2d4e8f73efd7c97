"""Runs split into chunks give the rows that whole runs give."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from runlens.operators import adaptation as A
from runlens.operators import snapshots as S
from runlens.operators.runs import large_keys
from runlens.plans.queries import DAY_MS, STALE_MS, shown
from runlens.sources.telemetry import gameplay_events

WORK = {
    "snapshots": lambda e: S.snapshots(e, last_n=3),
    "asof": lambda e: S.asof_features(S.fights(e), S.snapshots(e, upgrades=False)),
    "fights": S.fights_with_features,
    "velocities": A.carry_velocity,
    "alignments": lambda e: A.kill_alignment(e, last_n=4),
    "upgrades": S.running_upgrades,
    "forms": lambda e: A.brute_forms(e, last_n=4, min_n=2),
    "changes": lambda e: A.form_changes(e, last_n=4, min_n=2),
    "stale": lambda e: A.stale_forms(e, 1_706_800_000_000, STALE_MS, STALE_MS, 4, 2),
    "modes": lambda e: A.dash_mode(e, last_n=4),
    "predictions": lambda e: A.prediction_updates(e, tick_ms=DAY_MS),
}


def rows(frame):
    return sorted(str(row) for row in shown(frame).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One run holds a third of all events."""
    events = gameplay_events(spark, SMALL)
    hot = F.col("event_id") % 3 == 0
    return events.withColumn("run_id", F.when(hot, "run_hot").otherwise(F.col("run_id")))


@pytest.mark.parametrize("name", WORK)
def test_hot_run_is_split_without_a_trace(skewed, run_limit, name):
    whole = rows(WORK[name](skewed))
    run_limit(60)
    assert rows(WORK[name](skewed)) == whole


@pytest.mark.parametrize("name", ["snapshots", "changes", "predictions"])
def test_all_runs_split(skewed, run_limit, name):
    whole = rows(WORK[name](skewed))
    run_limit(9)
    assert rows(WORK[name](skewed)) == whole


def test_many_large_runs_stay_a_table(skewed, run_limit):
    run_limit(1)
    keys, chunks = S.large_keys(skewed.select("run_id"))
    assert keys.count() == skewed.select("run_id").distinct().count() and chunks > 1


def test_a_run_of_a_million_rows_is_split(spark):
    """One task holds the rows of a run in its windows: half a million at most."""
    rows = spark.range(1_100_000).selectExpr("if(id < 1000000, 'long', 'short') AS run_id")
    keys, chunks = large_keys(rows)
    assert [row.run_id for row in keys.collect()] == ["long"] and chunks >= 4
