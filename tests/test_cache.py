"""The feature cache: merged tiers, one pointer, nothing left behind."""

from pathlib import Path

import pytest

from conftest import values
from runlens.schemas import FEATURE_VECTOR
from runlens.sinks import cache
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture
def taken(spark):
    """Snapshots of a batch: 40 runs, of which each batch meets some."""
    schema = T.StructType([*[f for f in cache.CACHE.fields if f.name not in ("outcome", "weight")]])

    def make(batch, runs=range(40)):
        rows = []
        for run in runs:
            for no in range(2):
                row = {"run_id": f"r{run}", "timestamp": batch * 1000 + no, "event_id": batch,
                       "total_dashes": batch, "upgrade_counts": {"a": batch}}
                rows.append(tuple(row.get(name) for name in schema.fieldNames()))
        return spark.createDataFrame(rows, schema)

    return make


def newest(frame):
    return sorted(values(frame, "run_id", "timestamp", "total_dashes"))


def test_newest_rows_survive_merges_and_few_folders_stay(spark, taken, tmp_path):
    path, expected = str(tmp_path), {}
    for batch in range(20):
        runs = [run for run in range(40) if (run + batch) % 3 or batch < 2]
        cache.upsert_latest(taken(batch, runs), path, f"q-{batch}", fanout=3)
        expected.update({f"r{run}": (batch * 1000 + 1, batch) for run in runs})
        if batch in (4, 19):
            wanted = sorted((run, *row) for run, row in expected.items())
            assert newest(cache.read_features(spark, path)) == wanted
            keys = spark.createDataFrame([("r1",), ("r7",), ("r7",), ("new",)], "run_id string")
            assert newest(cache.read_features(spark, path, keys)) == [
                row for row in wanted if row[0] in ("r1", "r7")]
    version, live = cache.pointer(spark, path)
    assert version > 20 and len(live) <= 6  # two folders of each of three tiers
    # The files of the last pointers only: 40 runs fill at most 40 buckets of a merged folder.
    kept = list(Path(path, "data").glob("tier=*/folder=*"))
    assert len(kept) <= len(live) + 2 * 4 and len(list(Path(path, "pointer").glob("n*"))) == 3
    assert sum(len(list(folder.glob("bucket=*/*.parquet"))) for folder in kept) <= 40 * len(kept)


def test_a_batch_again_replaces_itself(spark, taken, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        cache.upsert_latest(taken(1, [1]), path, "a")
        cache.upsert_latest(taken(2, [2]), path, "b")
    assert [x.batch for x in cache.pointer(spark, path)[1]] == ["a", "b"]
    assert newest(cache.read_features(spark, path)) == [("r1", 1001, 1), ("r2", 2001, 2)]
    # Merged before it is tried again: added once more, to no effect.
    cache.compact_features(spark, path)
    cache.upsert_latest(taken(1, [1, 2]), path, "a")
    assert newest(cache.read_features(spark, path)) == [("r1", 1001, 1), ("r2", 2001, 2)]


def test_a_failed_try_shows_nothing(spark, taken, tmp_path, monkeypatch):
    path = str(tmp_path)
    cache.upsert_latest(taken(1, [1]), path, "a", fanout=2)
    before = newest(cache.read_features(spark, path))
    with monkeypatch.context() as broken:
        broken.setattr(cache, "_switch", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            cache.upsert_latest(taken(2, [1]), path, "b", fanout=2)
    assert newest(cache.read_features(spark, path)) == before
    cache.upsert_latest(taken(2, [1]), path, "b", fanout=2)
    assert newest(cache.read_features(spark, path)) == [("r1", 2001, 2)]


def test_two_writers_of_a_version_cannot_both_succeed(spark, taken, tmp_path):
    path = str(tmp_path)
    cache.upsert_latest(taken(1, [1]), path, "a")
    version, live = cache.pointer(spark, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        cache._switch(spark, path, version, [])
    assert cache.pointer(spark, path) == (version, live)


def test_nothing_cached_yet(spark, taken, tmp_path):
    path = str(tmp_path / "none")
    assert cache.pointer(spark, path) == (0, [])
    assert cache.read_features(spark, path).count() == 0
    cache.upsert_latest(taken(1, []), path, "empty")
    assert cache.read_features(spark, path).count() == 0


def test_files_carry_a_bloom_filter_and_few_buckets_are_read(spark, taken, tmp_path):
    path = str(tmp_path)
    cache.upsert_latest(taken(1), path, "a")
    cache.compact_features(spark, path)
    keys = spark.createDataFrame([("r1",)], "run_id string")
    plan = cache.read_features(spark, path, keys)._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters", 1)[1].split("PushedFilters")[0]
    columns = [f for f in FEATURE_VECTOR.fieldNames() if f in cache.CACHE.fieldNames()]
    assert cache.read_features(spark, path, keys).select(*columns).filter(
        F.col("run_id") == "r1").count() == 1
