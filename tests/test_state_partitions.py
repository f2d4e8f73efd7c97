"""Partitions of keyed state follow the cores and the rows, not the shuffle setting of the session."""

from pathlib import Path

import pytest

from runlens import constants as C
from runlens.plans.queries import Replayed, _written
from runlens.session import SHUFFLE_CONF, STATE_ROWS, state_partitions
from runlens.streaming import asof, profile


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get(SHUFFLE_CONF)
    spark.conf.set(SHUFFLE_CONF, "40")
    yield 40
    spark.conf.set(SHUFFLE_CONF, before)


def test_partitions_grow_with_rows_only(spark, many_partitions):
    cores = spark.sparkContext.defaultParallelism
    assert state_partitions(spark, 0) == state_partitions(spark, cores * STATE_ROWS) == cores
    assert state_partitions(spark, 60 * STATE_ROWS + 1) == 61


def test_replayed_streams_keep_few_stores(spark, flat, many_partitions, tmp_path):
    events = flat(*[{"event_type": C.STATUS, "run_id": f"r{n}"} for n in range(20)])
    replayed = Replayed(spark, events, events, slices=2)
    (fed,) = replayed.feeds

    def start(**trigger):
        return _written(profile.profile_stream(
            fed.watched(), event_time=True, delay=replayed.delay), str(tmp_path), **trigger)

    replayed.run(start, event_type="none")
    stores = [path.name for path in Path(tmp_path, "checkpoint/state/0").iterdir()
              if path.name.isdigit()]
    assert len(stores) == spark.sparkContext.defaultParallelism < many_partitions
    assert spark.conf.get(SHUFFLE_CONF) == str(many_partitions)


class Held:
    """A state that tells what it holds, and nothing beside: `exists` would be a call more."""

    def __init__(self, value=None):
        self.value = value

    def get(self):
        return self.value

    def getValue(self, key):
        return (self.value or {}).get(key)

    def iterator(self):
        return iter((self.value or {}).items())

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.value = {**(self.value or {}), key: value}


def test_profile_parts_take_one_read_and_one_write():
    state = Held()
    history = profile.History(state)
    for value in "ab":
        history.begin()
        history.push(value, 2)
        history.push(value.upper(), 2)
        history.store()
    assert state.value == (["B", "b"],)
    counts = profile.Counts(Held({("u",): (2,)}))
    counts.add("u")
    counts.add("v")
    counts.store()
    counts.begin()
    assert counts.get() == {"u": 3, "v": 1}


def test_asof_reads_lists_without_asking_for_them():
    class Empty:
        def get(self):
            return iter(())

    class Clock:
        def getExpiryTimeInMs(self):
            return 5

        getCurrentWatermarkInMs = getExpiryTimeInMs

    join = asof.AsOf(None)
    join.shots = join.fights = Empty()
    assert list(join.handleExpiredTimer(("r",), Clock(), Clock())) == []
