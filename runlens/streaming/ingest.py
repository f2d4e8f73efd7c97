"""From raw topic records to stored events: decoded, checked, on time, and once each.

A micro-batch is read once. Each of its records gets a status and is written with it, so nothing is
lost and all of them can be counted:

`good`         an event, flat, with its payload as a variant
`quarantined`  text that cannot be an event
`late`         an event behind the watermark, which operators downstream would drop unseen
`repeated`     an event that was delivered before, or earlier in the batch

The watermark of a batch is the largest event time of the batches before it, less the delay. Only
good events from the watermark on can be met again without being late, so these alone are looked up.
Watermark and counts come from the write itself and are kept by batch: a batch that is tried again
reads the same watermark and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runlens.schemas import FLAT_EVENT
from runlens.sources.events import checked_events, guard_triggers, usable_vectors
from runlens.sources.tables import read_lake, utc_day

GOOD, QUARANTINED, LATE, REPEATED = "good", "quarantined", "late", "repeated"
STATUSES = (GOOD, QUARANTINED, LATE, REPEATED)
KEY = ["run_id", "timestamp", "event_id"]

INGESTED = T.StructType([
    *FLAT_EVENT.fields, T.StructField("value", T.StringType()),
    T.StructField("payload", T.VariantType()), T.StructField("status", T.StringType()),
    T.StructField("dt", T.StringType()), T.StructField("batch", T.StringType()),
])
_LONG = T.LongType()
MARK = T.StructType([T.StructField("mark", _LONG), *[T.StructField(s, _LONG) for s in STATUSES]])


def judged(records: DataFrame, mark: int | None, recent: DataFrame) -> DataFrame:
    """Records with their status; `recent` has the keys of good events from the watermark on."""
    rows = checked_events(records)
    late = F.lit(False) if mark is None else F.col("timestamp") < mark
    rows = rows.withColumn("status", F.when(~F.col("good"), QUARANTINED).when(late, LATE).otherwise(
        GOOD))
    # Rows that are not good have a window each: they share no key, and many may share their text.
    alone = F.when(F.col("status") != GOOD, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    rows = rows.withColumn("alone", alone)
    first = F.row_number().over(Window.partitionBy("alone", *KEY).orderBy("value"))
    known = recent.select(*KEY).distinct().withColumn("known", F.lit(True))
    rows = rows.withColumn("first", first).join(known, KEY, "left")
    again = (F.col("status") == GOOD) & ((F.col("first") > 1) | F.coalesce("known", F.lit(False)))
    return rows.withColumns({
        "status": F.when(again, REPEATED).otherwise(F.col("status")),
        "value": F.when(~F.col("good"), F.col("value")),
        "dt": utc_day(F.timestamp_millis("timestamp")),
    }).select(*[name for name in INGESTED.fieldNames() if name != "batch"])


def read_records(spark: SparkSession, path: str, *statuses: str) -> DataFrame:
    """Stored records of the given statuses, of all without any."""
    rows = spark.read.schema(INGESTED).parquet(f"{path}/records")
    return rows.filter(F.col("status").isin(*statuses)) if statuses else rows


def read_good(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Good events for the profile: flat, with usable vectors and triggers."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(INGESTED).parquet(f"{path}/records").filter(F.col("status") == GOOD)
    return guard_triggers(usable_vectors(rows.select(*FLAT_EVENT.fieldNames())))


def _marks(path: str, query: str, number: int) -> str:
    return f"{path}/marks/query={query}/number={number}"


def mark_before(spark: SparkSession, path: str, batch: str) -> int | None:
    """Watermark that the batch before `batch` has left."""
    query, number = batch.rsplit("-", 1)
    found = read_lake(spark, _marks(path, query, int(number) - 1), MARK).collect()
    return found[0]["mark"] if found else None


def ingest_batch(records: DataFrame, path: str, batch: str, delay_ms: int) -> None:
    """Judge the records of a batch and store them, then its watermark and counts."""
    spark = records.sparkSession
    mark = mark_before(spark, path, batch)
    recent = spark.createDataFrame([], INGESTED)
    if mark is not None:
        # The day prunes folders, the time row groups.
        recent = read_records(spark, path, GOOD).filter(
            (F.col("dt") >= utc_day(F.timestamp_millis(F.lit(mark))))
            & (F.col("timestamp") >= mark) & (F.col("batch") != batch))
    seen = Observation("ingest")
    status = F.col("status")
    rows = judged(records, mark, recent).observe(
        seen, F.max(F.when(status == GOOD, F.col("timestamp"))).alias("newest"),
        *[F.count_if(status == name).alias(name) for name in STATUSES])
    rows.withColumn("batch", F.lit(batch)).write.option(
        "partitionOverwriteMode", "dynamic").partitionBy("status", "dt", "batch").mode(
            "overwrite").parquet(f"{path}/records")
    found = seen.get
    marks = [m for m in (mark, None if found["newest"] is None else found["newest"] - delay_ms)
             if m is not None]
    query, number = batch.rsplit("-", 1)
    spark.createDataFrame([(max(marks, default=None), *[found[name] for name in STATUSES])], MARK
                          ).coalesce(1).write.mode("overwrite").json(
                              _marks(path, query, int(number)))


def start_ingest(records: DataFrame, path: str, checkpoint: str, delay_ms: int = 10_000,
                 **trigger) -> StreamingQuery:
    """Ingest a topic of records with a text column `value`, maybe with `event_id`."""
    from runlens.streaming.jobs import start_batches

    return start_batches(records, lambda rows, batch: ingest_batch(rows, path, batch, delay_ms),
                         checkpoint, **trigger)


def ingest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Watermark and counts by status of each batch."""
    return read_lake(spark, f"{path}/marks", T.StructType([
        *MARK.fields, T.StructField("query", T.StringType()), T.StructField("number", _LONG)]))
