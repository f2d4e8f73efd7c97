"""History replayed through streaming queries in order of time, slice by slice.

Files of a table are in no order of time, so a file source over them would hand a stream old rows
after new ones. Here rows are cut at quantiles of their time, written once by slice, and fed into the
folders that a query watches, one slice after another: its batches follow the clock, none holds the
table, and a source of any format that Spark reads will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runlens.session import scratch_dir

SLICE, FEED = "slice", "feed"


def time_cuts(rows: DataFrame, slices: int, moment: str = "timestamp") -> list[int]:
    """Times that start a new slice: quantiles, by one aggregate."""
    at = [k / slices for k in range(1, slices)]
    found = rows.agg(F.percentile_approx(moment, at, 10_000)).first()[0] if at else None
    return sorted(set(found or []))


def even_cuts(rows: DataFrame, slices: int, moment: str = "timestamp") -> list[int]:
    """Times that cut the whole span into slices of equal length."""
    low, high = rows.agg(F.min(moment), F.max(moment)).first()
    return [] if low is None else [low + (high - low) * k // slices for k in range(1, slices)]


def slice_number(cuts: Sequence[int], moment: str = "timestamp") -> Column:
    number = F.lit(0)
    for cut in cuts:
        number = number + F.coalesce((F.col(moment) >= cut).cast("int"), F.lit(0))
    return number


def stored(rows: DataFrame, moment: str = "timestamp") -> DataFrame:
    """Rows with a column `slice`, written once so that each slice is read alone."""
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/slices-{uuid.uuid4().hex}"
    rows.repartitionByRange(SLICE, moment).write.partitionBy(SLICE).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def by_slice(rows: DataFrame, cuts: Sequence[int], moment: str = "timestamp") -> DataFrame:
    return stored(rows.withColumn(SLICE, slice_number(cuts, moment)), moment)


def feed(rows: DataFrame, folder: str) -> None:
    """Append rows to a watched folder."""
    rows.write.mode("append").parquet(folder)


def finish(query: StreamingQuery, seconds: int = 3600) -> None:
    """Wait for a query that ends by itself."""
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"{query.name or query.id} did not end in {seconds} s")
    finally:
        query.stop()


@dataclass(frozen=True)
class Feed:
    """Rows by slice and the folder they are fed into, `lag` slices after their turn."""

    rows: DataFrame
    folder: str
    lag: int = 0

    def watched(self) -> DataFrame:
        """The folder as a stream."""
        fields = [field for field in self.rows.schema if field.name != SLICE]
        return self.rows.sparkSession.readStream.schema(T.StructType(fields)).parquet(self.folder)

    def due(self, number: int) -> DataFrame:
        return self.rows.filter(F.col(SLICE) == number).drop(SLICE)

    def put(self, number: int) -> None:
        feed(self.due(number), self.folder)

    def put_clock(self, moment: int, **values) -> None:
        """A row without a run and an event, which moves the watermark and nothing else."""
        rows = self.rows.drop(SLICE)
        values["timestamp"] = moment
        feed(self.rows.sparkSession.createDataFrame(
            [tuple(values.get(name) for name in rows.columns)], rows.schema), self.folder)


def side_by_side(tables: Sequence[DataFrame], folder: str) -> list[Feed]:
    """Feeds into folders beside each other, each table a slice later than the one before."""
    return [Feed(rows, f"{folder}/{FEED}={lag}", lag) for lag, rows in enumerate(tables)]


def put_turn(feeds: Sequence[Feed], turn: int) -> None:
    """Append what is due in a turn to all feeds.

    Feeds side by side get it by one write, so that one micro-batch finds it all instead of one
    for each feed. A batch that starts while the write commits holds a part, which is as right.
    """
    folder = feeds[0].folder.rpartition("/")[0]
    together = len(feeds) > 1 and all(
        fed.folder == f"{folder}/{FEED}={at}" for at, fed in enumerate(feeds))
    if turn == 0 or not together:
        for fed in feeds:
            fed.put(turn - fed.lag)  # before its turn an empty slice: the folder is there
        return
    rows = [fed.due(turn - fed.lag).withColumn(FEED, F.lit(at)) for at, fed in enumerate(feeds)]
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).write.partitionBy(
        FEED).mode("append").parquet(folder)


def longest(cuts: Sequence[int], low: int, high: int) -> int:
    """Length of the longest slice: a delay that keeps all rows of a slice on time."""
    ends = [low, *cuts, high]
    return max(b - a for a, b in zip(ends, ends[1:])) + 1


def replay(feeds: Sequence[Feed], slices: int, start: Callable[..., StreamingQuery],
           restarts: Sequence[int] | None = None, closing: Callable[[Feed], None] | None = None,
           ) -> int:
    """Feed slice after slice of all tables to a query; returns the number of its last batch.

    `start(**trigger)` begins the query or resumes it from its checkpoint. Without `restarts` each
    turn is a run of its own, which works on all that was fed and ends. With `restarts` the query
    goes on through all turns, and is only stopped and resumed before those: cheaper where planning
    is dear, but a batch may then hold a part of a turn. Last, `closing` puts a clock row into each
    feed, and the query runs to its end, so that timers due by then fire.
    """
    turns, last, query = slices + max(fed.lag for fed in feeds), -1, None
    try:
        for turn in range(turns):
            put_turn(feeds, turn)
            if restarts is None or (turn in restarts and query):
                last = max(last, _ended(query))
                query = None
            if query is None:
                query = start(**({"availableNow": True} if restarts is None else {}))
            if restarts is None:
                finish(query)
            else:
                query.processAllAvailable()
        last = max(last, _ended(query))
    finally:
        _ended(query)
    if closing is not None or restarts is not None:
        for fed in feeds if closing is not None else ():
            closing(fed)
        query = start(availableNow=True)
        finish(query)
        last = max(last, _ended(query))
    return last


def _ended(query: StreamingQuery | None) -> int:
    """Stop a query; its last batch."""
    if query is None:
        return -1
    query.stop()
    return max([progress["batchId"] for progress in query.recentProgress], default=-1)
