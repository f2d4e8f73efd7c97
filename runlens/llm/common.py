"""Helpers the operators share: passing rows through, text as bytes, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "_row"
#: What separates words: space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: What an entry takes in a dictionary that grew to hold it.
SLOT_BYTES = 64


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns of `df` inside one struct, beside named work columns.

    Work columns can then never clash with columns of the caller, whatever those are called.
    """
    return df.select(F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias(ROW),
                     *[column.alias(name) for name, column in columns.items()])


def unpacked(rows: DataFrame, replaced: Iterable[str] = (), **columns: Column) -> DataFrame:
    """Inverse of `packed`: the caller's columns, then `columns`.

    Columns of the caller that are called like a new one, in any case, give way to it.
    """
    gone = {name.lower() for name in (*replaced, *columns)}
    kept = [F.col(f"{ROW}.`{name}`") for name in rows.schema[ROW].dataType.fieldNames()
            if name.lower() not in gone]
    return rows.select(*kept, *[column.alias(name) for name, column in columns.items()])


def utf8(column: Column | str) -> Column:
    """Whole text as UTF-8 bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


class Remembered(dict):
    """Results of `work` by argument, of at most about `most` bytes.

    Every worker of an executor holds its own, so the bound is one of bytes, not of entries. Half of
    it is for entries of the time before the last half filled up: those met again move over, the
    others go.
    """

    def __init__(self, work: Callable, most: int) -> None:
        super().__init__()
        self.work, self.most, self.held, self.former = work, most, 0, {}

    def __missing__(self, key):
        value = self.former.get(key)
        if value is None:
            value = self.work(key)
        self.held += getsizeof(key) + getsizeof(value) + SLOT_BYTES
        if 2 * self.held > self.most:
            self.former = dict(self)
            self.clear()
            self.held = getsizeof(key) + getsizeof(value) + SLOT_BYTES
        if 2 * self.held <= self.most:
            self[key] = value
        return value


def lists(values: pa.Array, sizes: Iterable[int]) -> pa.ListArray:
    """List array of consecutive runs of `values`."""
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
