"""Ordered work per run that survives a run of any size.

A plain window over `run_id` puts a whole run into one task. Here the runs are counted first (a
partial aggregate). Runs within the limit take the plain window. A larger run is range-partitioned
on its full order, so that it spans as many chunks as it needs, and every chunk starts with a few
*lead-in* rows that stand for what came before: running totals, last known values, or the last n
rows. The same window expressions then run on (run, chunk), and lead-in rows are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from runlens.session import stage

MAX_ROWS_CONF = "spark.runlens.maxRowsPerRun"
MAX_ROWS = 500_000

ORDER = ("timestamp", "event_id")
_TOTALS, _TAIL, _OWN = 0, 1, 2


@dataclass(frozen=True)
class RunFrame:
    """Rows of whole runs, or of runs split into ordered chunks."""

    df: DataFrame
    by: tuple[str, ...] = ("run_id",)
    order_by: tuple[str, ...] = ORDER
    split: bool = False

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.by, "chunk") if self.split else self.by

    @property
    def order(self) -> tuple[str, ...]:
        return ("lead_in", *self.order_by) if self.split else self.order_by

    def window(self, *extra: Column | str) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order)

    def running(self, *extra: Column | str) -> WindowSpec:
        return self.window(*extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def last_rows(self, n: int, *extra: Column | str) -> WindowSpec:
        return self.window(*extra).rowsBetween(1 - n, Window.currentRow)

    def on(self, df: DataFrame) -> RunFrame:
        return replace(self, df=df)

    def settled(self) -> RunFrame:
        """Write split rows proper out once before they are read for both totals and windows."""
        return self.on(stage(self.own(), "runs")) if self.split else self

    def gathered(self) -> RunFrame:
        """Place the rows of each run, or chunk, in one partition for all windows to come."""
        return self.on(self.df.repartition(*self.keys))

    def own(self) -> DataFrame:
        """The rows proper, without lead-in rows."""
        return self.df.filter(F.col("lead_in") == _OWN) if self.split else self.df

    def result(self, *columns: Column | str) -> DataFrame:
        return self.own().select(*columns)

    def _lead(self, rows: DataFrame, place: int) -> RunFrame:
        rows = rows.withColumn("lead_in", F.lit(place))
        return self.on(self.df.unionByName(rows, allowMissingColumns=True))

    def with_totals(self, sums: Sequence[str] = (), lasts: Sequence[str] = (),
                    firsts: Sequence[str] = ()) -> RunFrame:
        """Head each chunk with the sums and the last and first non-null values before it."""
        if not self.split:
            return self

        def place(name: str) -> Column:
            return F.when(F.col(name).isNotNull(), F.struct(*self.order_by))

        per_chunk = self.own().groupBy(*self.keys).agg(
            *[F.sum(name).alias(name) for name in sums],
            *[F.max_by(name, place(name)).alias(name) for name in lasts],
            *[F.min_by(name, place(name)).alias(name) for name in firsts],
        )
        chunks = Window.partitionBy(*self.by).orderBy("chunk")
        before = chunks.rowsBetween(Window.unboundedPreceding, -1)
        lead = per_chunk.select(
            *self.keys, F.row_number().over(chunks).alias("_at"),
            *[F.sum(name).over(before).alias(name) for name in sums],
            *[F.last(name, ignorenulls=True).over(before).alias(name) for name in lasts],
            *[F.first(name, ignorenulls=True).over(before).alias(name) for name in firsts],
        )
        return self._lead(lead.filter("_at > 1").drop("_at"), _TOTALS)

    def with_rows(self, rows: DataFrame) -> RunFrame:
        """Head each chunk with rows the caller computed, one per (run, chunk)."""
        return self._lead(rows, _TOTALS) if self.split else self

    def with_tail(self, n: int, columns: Sequence[str],
                  qualifies: Column | None = None) -> RunFrame:
        """Head each chunk with the last n qualifying rows of all chunks before it.

        The rows carry the named columns and their place in the order, nothing else.

        Only chunks that hold qualifying rows take part in the frame of n chunks, so the frame
        always reaches n rows if the run has them. Arrays never exceed n*n rows.
        """
        if not self.split:
            return self
        hit = F.lit(True) if qualifies is None else F.coalesce(qualifies, F.lit(False))
        own = self.own().select(*self.keys, *self.order_by, *columns)
        row = F.struct(*self.order_by, *columns)
        newest = Window.partitionBy(*self.keys).orderBy(*[F.desc(name) for name in self.order_by])
        tails = (
            own.filter(hit).withColumn("_rank", F.row_number().over(newest))
            .filter(F.col("_rank") <= n)
            .groupBy(*self.keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
        )
        chunks = Window.partitionBy(*self.by).orderBy("chunk")
        joined = F.flatten(F.collect_list("_rows").over(chunks.rowsBetween(1 - n, 0)))
        tails = tails.withColumn("_rows", F.when(F.size(joined) <= n, joined).otherwise(
            F.slice(joined, -n, n)))
        every = own.select(*self.keys).distinct().join(tails, list(self.keys), "left")
        before = F.last("_rows", ignorenulls=True).over(
            chunks.rowsBetween(Window.unboundedPreceding, -1))
        lead = every.select(*self.keys, before.alias("_rows")).select(
            *self.keys, F.explode("_rows").alias("_row"))
        return self._lead(lead.select(*self.keys, "_row.*"), _TAIL)


def max_rows_per_run(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))


def large_keys(rows: DataFrame, by: tuple[str, ...] = ("run_id",),
               ) -> tuple[DataFrame, int] | None:
    """Keys with more rows than one task should take, and the number of chunks they need.

    One pass: a partial count per key. Only the sum of the large keys' rows reaches the driver. The
    keys stay a table, written when there are any; adaptive execution broadcasts it where its
    measured size is small.
    """
    limit = max_rows_per_run(rows)
    large = rows.groupBy(*by).count().filter(F.col("count") > limit)
    total = large.agg(F.sum("count")).first()[0]
    if total is None:
        return None
    return stage(large.select(*by), "large"), 1 + total // max(1, limit // 2)


def by_run(
    rows: DataFrame,
    work: Callable[[RunFrame], DataFrame],
    by: tuple[str, ...] = ("run_id",),
    order_by: tuple[str, ...] = ORDER,
    checked: bool = False,
) -> DataFrame:
    """Apply `work` to runs that fit one task and, with split runs, to those that do not.

    `checked` says that the caller has counted rows that hold these and found no large run.
    """
    large = None if checked else large_keys(rows, by)
    if large is None:
        return work(RunFrame(rows, by, order_by))
    keys, chunks = large
    ranged = (
        rows.join(keys, list(by), "left_semi")
        .repartitionByRange(chunks, *by, *order_by)
        .withColumn("chunk", F.spark_partition_id())
        .withColumn("lead_in", F.lit(_OWN))
    )
    split = RunFrame(stage(ranged, "runs"), by, order_by, split=True)
    whole = RunFrame(rows.join(keys, list(by), "left_anti"), by, order_by)
    return work(whole).unionByName(work(split))


def newest(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key.

    The rank filter lets Spark cut every map task to n rows per key before the shuffle.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(name) for name in order_by])
    return rows.withColumn("_rank", F.row_number().over(window)).filter(
        F.col("_rank") <= n).drop("_rank")


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(DataFrame.unionByName, others, first)
