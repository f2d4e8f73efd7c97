"""Feature cache: the newest snapshot per run, as a few live folders that a pointer names.

A micro-batch adds one small folder. When `FANOUT` folders of a tier are live, the same job merges
them into one folder of the next tier, with the newest snapshot per run, so a cache of n batches has
about FANOUT * log(n) live folders. The pointer is a file of its own per version, written by one
rename: readers take the newest, and see all of a change or none of it. Folders that the last
`KEPT_VERSIONS` pointers no longer name are removed.

A batch that is tried again replaces its folder; one already merged is added once more, which
changes nothing, as only the newest snapshot of a run counts. A cache has one writing query.

Merged folders are split by bucket of the run id, and sorted by it. All files carry a bloom filter of
their run ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.training import latest
from runlens.schemas import FEATURE_VECTOR
from runlens.sources.tables import read_lake

BUCKETS = 256
#: Live folders of a tier before they are merged, and pointers whose folders are kept for readers.
FANOUT = 8
KEPT_VERSIONS = 3
#: Rows that one file of a merged bucket may hold.
RECORDS_PER_FILE = 5_000_000

CACHE = T.StructType([
    *FEATURE_VECTOR.fields, T.StructField("player_id", T.StringType()),
    T.StructField("boss_archetype", T.StringType()), T.StructField("timestamp", T.LongType()),
    T.StructField("event_id", T.LongType()),
])
_STORED = T.StructType([
    *CACHE.fields, T.StructField("tier", T.IntegerType()), T.StructField("folder", T.StringType()),
    T.StructField("bucket", T.IntegerType())])
_POINTER = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("live", T.ArrayType(T.StructType([
        T.StructField("batch", T.StringType()), T.StructField("tier", T.IntegerType()),
        T.StructField("folder", T.StringType())])))])
_ORDER = ("timestamp", "event_id")
#: Bucket of rows in folders that are not split.
_UNPLACED = -1


@dataclass(frozen=True)
class Live:
    """A folder that the pointer names; merged ones have no batch."""

    batch: str | None
    tier: int
    folder: str


def bucket() -> Column:
    return F.pmod(F.hash("run_id"), F.lit(BUCKETS)).cast("int")


def pointer(spark: SparkSession, path: str) -> tuple[int, list[Live]]:
    """Newest version and its live folders; version 0 of a cache that is not there yet."""
    found = read_lake(spark, f"{path}/pointer", _POINTER).orderBy(F.desc("version")).limit(
        1).collect()
    if not found:
        return 0, []
    return found[0]["version"], [Live(**row.asDict()) for row in found[0]["live"]]


def _switch(spark: SparkSession, path: str, version: int, live: Sequence[Live]) -> None:
    """Name the live folders of a version. Two writers of one version cannot both succeed."""
    rows = [(version, [(x.batch, x.tier, x.folder) for x in live])]
    spark.createDataFrame(rows, _POINTER).coalesce(1).write.mode("error").json(
        f"{path}/pointer/number={version:012d}")


def _write(rows: DataFrame, path: str, tier: int) -> str:
    """Write rows to a folder of their own: small ones as they are, merged ones by bucket."""
    folder = f"tier={tier}/folder={uuid.uuid4().hex}"
    if tier == 0:
        placed = rows.withColumn("bucket", F.lit(_UNPLACED)).sortWithinPartitions("run_id")
    else:
        placed = rows.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions(
            "bucket", "run_id")
    placed.write.option("parquet.bloom.filter.enabled#run_id", "true").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).partitionBy("bucket").parquet(
            f"{path}/data/{folder}")
    return folder


def _read(spark: SparkSession, path: str, live: Sequence[Live],
          keys: DataFrame | None = None) -> DataFrame:
    """Rows of live folders, of all runs or of those in `keys`.

    Only the numbers of the buckets that hold keys, 256 at most, come to the driver: they prune the
    folders to read. The keys themselves are joined.
    """
    if not live:
        return spark.createDataFrame([], CACHE)
    base = f"{path}/data"
    rows = spark.read.schema(_STORED).option("basePath", base).parquet(
        *[f"{base}/{found.folder}" for found in live])
    if keys is not None:
        wanted = keys.select("run_id").distinct()
        if any(found.tier for found in live):
            used = [row[0] for row in wanted.select(bucket().alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(_UNPLACED, *used))
        rows = rows.join(wanted, "run_id", "left_semi")
    return rows.select(*CACHE.fieldNames())


def _newest(rows: DataFrame) -> DataFrame:
    return latest(rows, "run_id", *_ORDER)


def upsert_latest(snapshots: DataFrame, path: str, batch: str, fanout: int = FANOUT) -> None:
    """Add the newest snapshot per run of a batch, merge tiers that are full, drop what is unused."""
    spark = snapshots.sparkSession
    rows = _newest(snapshots).withColumns({
        "outcome": F.lit(-1), "weight": F.lit(1.0)}).select(*CACHE.fieldNames())
    version, live = pointer(spark, path)
    live = [x for x in live if x.batch != batch] + [Live(batch, 0, _write(rows, path, 0))]
    _switch(spark, path, version + 1, live)
    version, tier = version + 1, 0
    while (full := [x for x in live if x.tier == tier]) and len(full) >= fanout:
        live = _merged(spark, path, live, full, tier + 1)
        version, tier = version + 1, tier + 1
        _switch(spark, path, version, live)
    remove_unused(spark, path)


def _merged(spark: SparkSession, path: str, live: Sequence[Live], parts: Sequence[Live],
            tier: int) -> list[Live]:
    folder = _write(_newest(_read(spark, path, parts)), path, tier)
    return [x for x in live if x not in parts] + [Live(None, tier, folder)]


def read_features(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Newest snapshot per run; `keys` restricts folders and runs before anything is ranked."""
    return _newest(_read(spark, path, pointer(spark, path)[1], keys))


def compact_features(spark: SparkSession, path: str, target: str | None = None) -> None:
    """Merge all live folders into one, in place or as a cache of its own at `target`."""
    version, live = pointer(spark, path)
    tier = 1 + max([x.tier for x in live], default=0)
    if target is None:
        _switch(spark, path, version + 1, _merged(spark, path, live, live, tier))
        remove_unused(spark, path)
        return
    folder = _write(_newest(_read(spark, path, live)), target, tier)
    _switch(spark, target, pointer(spark, target)[0] + 1, [Live(None, tier, folder)])


def remove_unused(spark: SparkSession, path: str, kept: int = KEPT_VERSIONS) -> None:
    """Remove old pointers, and folders that none of the last `kept` names.

    Folders of a try that failed before its pointer was written go as well: none names them.
    """
    every = {row["version"]: row["live"] for row in read_lake(
        spark, f"{path}/pointer", _POINTER).collect()}
    old = sorted(every)[:-kept]
    named = {x["folder"] for version, live in every.items() if version not in old for x in live}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    base = files.Path(path)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for version in old:
        system.delete(files.Path(f"{path}/pointer/number={version:012d}"), True)
    for tier in system.listStatus(files.Path(f"{path}/data")):
        for folder in system.listStatus(tier.getPath()):
            at = folder.getPath()
            if f"{tier.getPath().getName()}/{at.getName()}" not in named:
                system.delete(at, True)
