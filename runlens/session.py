"""Session helpers: a tuned session, and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
STATE_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A commit uploads what the micro-batch changed instead of the files of the whole state.
STATE_CHANGES_CONF = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
SHUFFLE_CONF = "spark.sql.shuffle.partitions"
#: Rows over a stream's whole life that one partition of keyed state should see.
STATE_ROWS = 1_000_000
#: Rows over a stream's whole life of the runs that share one part of a state kept by parts.
PART_ROWS = 10_000


def build_session(master: str | None = None, app: str = "runlens", **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; `conf` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        STATE_STORE_CONF: STATE_STORE,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables, as the cluster names it.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    shared = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
    return spark.sparkContext.getCheckpointDir()


def state_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of keyed state for a stream of so many rows.

    Each micro-batch opens and commits the store of every partition, busy or not, and adaptive
    execution does not merge them. So there are as many as run at once, and more only for more rows.
    """
    at_once = min(int(spark.conf.get(SHUFFLE_CONF)), spark.sparkContext.defaultParallelism)
    return max(1, at_once, -(-rows // STATE_ROWS))


def state_parts(spark: SparkSession, rows: int) -> int:
    """Parts of a state that holds many runs each: enough to fill all partitions evenly."""
    return max(16 * state_partitions(spark, rows), -(-rows // PART_ROWS))


@contextmanager
def shuffled_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Streams started inside shuffle into so many partitions, for good: the checkpoint keeps it."""
    before = spark.conf.get(SHUFFLE_CONF)
    spark.conf.set(SHUFFLE_CONF, partitions)
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CONF, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage, fixes partition-derived columns, survives lost executors, and lets each later
    reader prune columns.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
