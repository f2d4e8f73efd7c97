"""Table and file writers.

A training table is one partitioned folder, `boss_archetype=<name>`, so all archetypes are written
by one job. `batch` partitions make a replayed micro-batch overwrite itself; the name of a batch
holds the id of its query, so that two queries never overwrite each other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.operators.training import to_lake
from runlens.schemas import LAKE, TRAINING
from runlens.sinks.cache import compact_features, read_features, upsert_latest  # noqa: F401
from runlens.sources.tables import read_lake, seed_rows, utc_day

RECORDS_PER_FILE = 1000

SEED_BATCH = "seed"
FULL_BATCH = "full"
_BATCH = T.StructField("batch", T.StringType())
_ARCHETYPE = T.StructField("boss_archetype", T.StringType())
_TABLE = T.StructType([*TRAINING.fields, _ARCHETYPE, _BATCH])


def _replace_batch(rows: DataFrame, batch: str, keys: tuple[str, ...]):
    return rows.withColumn("batch", F.lit(batch)).write.option(
        "partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite")


def append_lake(records: DataFrame, path: str, batch: str) -> None:
    """Add a batch of records by archetype; the same batch again replaces itself."""
    _replace_batch(to_lake(records), batch, ("boss_archetype", "batch")).json(path)


def table_names(archetypes: Iterable[str] = C.ARCHETYPES) -> dict[str, str]:
    return {name: f"{name}{C.TABLE_SUFFIX}" for name in archetypes}


def _keyed(records: DataFrame) -> DataFrame:
    return records.select("boss_archetype", *TRAINING.fieldNames())


def overwrite_training(records: DataFrame, path: str,
                       archetypes: Iterable[str] = C.ARCHETYPES, dry_run: bool = False,
                       ) -> DataFrame:
    """Replace the training tables of the listed archetypes by `records`, in one job.

    The whole folder is replaced: an archetype without records is left empty, as is any batch
    appended before.
    """
    wanted = _keyed(records).filter(F.col("boss_archetype").isin(*archetypes))
    if not dry_run:
        wanted.withColumn("batch", F.lit(FULL_BATCH)).write.option(
            "partitionOverwriteMode", "static").partitionBy("boss_archetype", "batch").mode(
                "overwrite").parquet(path)
    return wanted


def append_training(records: DataFrame, path: str, batch: str, dry_run: bool = False,
                    ) -> DataFrame:
    """Add a batch to the tables of the archetypes it holds; the same batch again replaces itself."""
    rows = _keyed(records)
    if not dry_run:
        _replace_batch(rows, batch, ("boss_archetype", "batch")).parquet(path)
    return rows


def ensure_tables(spark: SparkSession, path: str) -> None:
    """Create the training folder with its schema when nothing was written yet."""
    spark.createDataFrame([], _TABLE).write.mode("ignore").parquet(path)


def read_training(spark: SparkSession, path: str, archetype: str | None = None) -> DataFrame:
    """Training rows; an archetype without any is an empty frame with the same schema."""
    rows = spark.read.schema(_TABLE).parquet(path).drop("batch")
    return rows if archetype is None else rows.filter(F.col("boss_archetype") == archetype)


def new_seeds(lake: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed rows the lake does not hold yet, so that seeding again adds nothing.

    The fixed handful of seed keys is sent to the lake scan, not the lake to the seeds.
    """
    key = ["run_id", "encounterId"]
    held = lake.join(F.broadcast(seeds.select(*key)), key, "left_semi").select(*key).distinct()
    return seeds.join(held, key, "left_anti").select(*LAKE.fieldNames())


def seed_if_absent(spark: SparkSession, path: str) -> int:
    """Append missing seed rows to the lake; returns how many."""
    missing = new_seeds(read_lake(spark, path), seed_rows(spark)).collect()
    if missing:
        append_lake(spark.createDataFrame(missing, LAKE), path, SEED_BATCH)
    return len(missing)


def with_day(records: DataFrame, moment: str = "record_time") -> DataFrame:
    """Add `dt`, the UTC day of the record."""
    return records.withColumn("dt", utc_day(F.col(moment)))


def land_raw(records: DataFrame, path: str, checkpoint: str, interval: str = "60 seconds",
             moment: str = "record_time", records_per_file: int = RECORDS_PER_FILE, **trigger):
    """Stream records to day folders; large topics want far more `records_per_file`."""
    writer = with_day(records, moment).select("value", "dt").writeStream.format("text")
    return (
        writer.partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", records_per_file)
        .trigger(**(trigger or {"processingTime": interval})).start()
    )
