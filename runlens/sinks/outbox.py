"""One commit for all outputs of a micro-batch.

Every topic has a folder per batch. A batch counts once its mark is there: one file, written last, by
one rename. Readers of `read_topic` therefore see all messages of a batch or none, whatever fails
between the writes, and a batch that is tried again replaces what it had written without a mark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from runlens.sinks.topics import write_topic
from runlens.sources.tables import read_lake

#: Underscored, so that readers of the topic folders pass over it.
MARKS = "_committed"
_MARK = T.StructType([T.StructField("topic", T.StringType()), T.StructField("batch", T.StringType())])
_STORED = T.StructType([T.StructField("value", T.StringType()),
                        T.StructField("batch", T.StringType())])


def commit(path: str, batch: str, messages: Mapping[str, DataFrame], fmt: str = "parquet",
           before_mark: Callable[[], None] = lambda: None, **options: str) -> None:
    """Write the messages of all topics, do what must be seen no later than they are, and commit."""
    spark = next(iter(messages.values())).sparkSession
    for topic, rows in messages.items():
        write_topic(rows, topic, fmt, path=path, batch=batch, **options)
    before_mark()
    spark.createDataFrame([(topic, batch) for topic in messages], _MARK).coalesce(1).write.mode(
        "overwrite").json(f"{path}/{MARKS}/{batch}")


def read_topic(spark: SparkSession, path: str, topic: str, fmt: str = "parquet") -> DataFrame:
    """Messages of committed batches, with their batch."""
    marks = read_lake(spark, f"{path}/{MARKS}/*", _MARK)
    done = marks.filter(marks["topic"] == topic).select("batch").distinct()
    if done.isEmpty():
        return spark.createDataFrame([], _STORED)
    # A batch's name is text, whatever it looks like.
    rows = spark.read.schema(_STORED).format(fmt).load(f"{path}/{topic}")
    return rows.join(done, "batch", "left_semi").select("value", "batch")
