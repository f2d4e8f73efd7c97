"""Shards along a Hilbert curve.

Metadata dimensions are quantised to cells of a grid, rows are sorted by the index of their cell on
the Hilbert curve through it, and the order is cut into runs of equal count. Neighbours on the
curve are neighbours in every dimension, so a file covers a small range of each and scans can skip
files by any of them.

The rank of a row comes from one range-partitioned sort: its number within its partition, which is
written with it, plus the rows of the partitions before, a table of one row per partition. A random
number written with each row breaks the last ties, so that a third of all rows may be one row
repeated and still spread over partitions. Null dimensions fall into cell 0. An empty table gives
no rows; with fewer rows than shards, some shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import ROW, packed, unpacked
from runlens.session import stage

BITS = 6
_IN_PARTITION = (1 << 33) - 1


def named_cell(column: Column | str, bits: int = BITS) -> Column:
    """Cell of a categorical value: equal values share one, so files prune by equality."""
    column = F.col(column) if isinstance(column, str) else column
    cell = F.pmod(F.xxhash64(column.cast("string")), F.lit(1 << bits))
    return F.when(column.isNotNull(), cell).otherwise(0).cast("int")


def scaled_cell(column: Column | str, bits: int = BITS, steps: int = 3) -> Column:
    """Cell of a size: `steps` cells for each doubling, up to the last cell."""
    column = F.col(column) if isinstance(column, str) else column
    cell = F.floor(F.log2(F.greatest(column.cast("double"), F.lit(0.0)) + 1) * steps)
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def hilbert_index(axes: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of cells given by one integer array per dimension.

    The cell's coordinates are turned into the transposed index bit plane by bit plane, from the
    highest: each plane is reflected or exchanged with the first axis, then Gray-decoded.
    """
    x = [axis.astype(np.int64) for axis in axes]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ turn) >> bit) & 1)
    return index


def curve_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Hilbert index of a row's cells, each within 0 and 2**bits - 1."""
    if len(cells) * bits > 62:
        raise ValueError("the index must fit a long")

    def index(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            axes = [field.to_numpy(zero_copy_only=False) for field in batch.flatten()]
            yield pa.array(hilbert_index(axes, bits), pa.int64())

    index.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    cells = [cell.alias(f"c{i}") for i, cell in enumerate(cells)]
    return F.arrow_udf(index, "bigint")(F.struct(*cells))


def ranked(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with `place`, their number from 0 in the global order, and the count of all rows."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))),
                  "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    place = F.col("at").bitwiseAND(F.lit(_IN_PARTITION)) + F.col("before")
    return placed.withColumn("part", part).join(sizes.drop("n"), "part").withColumn(
        "place", place).drop("part", "at", "before"), total


def shard(df: DataFrame, cells: Sequence[Column], shards: int, ties: Sequence[Column] = (),
          bits: int = BITS) -> DataFrame:
    """Columns of `df`, then `curve` index, `shard` and `slot`, the row's number in its shard.

    Counts of shards differ by one at most. `ties` order the rows of a cell.
    """
    names = [f"tie{i}" for i in range(len(ties))]
    rows = packed(df, curve=curve_index(cells, bits), **dict(zip(names, ties)), draw=F.rand(5))
    placed, total = ranked(stage(rows, "keyed"), ["curve", *names, "draw"])
    total = max(1, total)
    number = F.expr(f"place * {shards} div {total}")
    first = F.expr(f"((place * {shards} div {total}) * {total} + {shards - 1}) div {shards}")
    return unpacked(placed.select(ROW, "curve", "place", number.alias("number"),
                                  (F.col("place") - first).alias("slot")),
                    curve=F.col("curve"), shard=F.col("number").cast("int"), slot=F.col("slot"))
