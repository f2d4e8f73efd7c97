"""Quality classifier: random Fourier features, ridge by partition sums, isotonic calibration.

Statistics of a document (lengths, shares of byte classes, repetition, compression) are
standardised and mapped to random Fourier features, whose inner products approximate a Gaussian
kernel. Ridge regression on them needs only the sums of outer products, which partitions add up: the
driver sees a few matrices of fixed size, however many rows are labelled, and all labelled rows
count. Isotonic regression on counts per score bin turns scores into shares of good documents.

A null or empty text has statistics of zero and is scored like any other. Rows without an id are
scored and never learned from; repeated rows count as often as they occur; of contradicting labels
the lowest counts, null labels do not. Without any label every score is 1: nothing speaks against
a document. An empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import lists, utf8

_CLASSES = (range(65, 91), range(97, 123), range(48, 58), b" ", b"\n", b"\t\v\f\r", b".,", b";:'\"()-",
            b"!?", b"#*$%&|<>", b"{}[]=+/\\_@^~`", range(0x80, 0xC0), range(0xC0, 0x100))
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES):
    _TABLE[list(_bytes), _i] = 1
#: Statistics of a document.
STATISTICS = len(_CLASSES) + 11

FEATURES = 256
#: Kernel width, in standard deviations of a statistic times the root of their number.
WIDTH = 0.6
RIDGE = 1e-3
#: Bins of raw scores for the calibration, over scores from -1 to 2.
BINS = 3000
#: Partial sums are added up in so many tasks before the driver adds the rest.
SUMS = 8


def statistics(data: bytes, compress=None) -> list[float]:
    """Statistics of one text, each of the order of one."""
    n = len(data)
    if not n:
        return [0.0] * STATISTICS
    compress = compress or zstandard.ZstdCompressor(level=1, write_content_size=False).compress
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words = data.split()
    m = max(1, len(words))
    often = Counter(words)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    starts = bytes([word[0] for word in words])
    ends = bytes([word[-1] for word in words])
    return [
        *(counts @ _TABLE / n).tolist(), float(np.log1p(n)), float(np.log1p(len(words))),
        float(-(share * np.log2(share)).sum()), (n - len(words)) / m / 8, len(often) / m,
        max(often.values(), default=0) / m, sum(map(eq, words, words[1:])) / m,
        min(2.0, len(compress(data)) / n), 1 - len(set(lines)) / max(1, len(lines)),
        len(ends.translate(None, b".,!?;:")) / m,
        len(starts.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / m]


def document_statistics(text: Column | str) -> Column:
    """Statistics of whole texts, as array<float>."""

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compress = zstandard.ZstdCompressor(level=1, write_content_size=False).compress
        for batch in batches:
            rows = [statistics(data.as_py(), compress) for data in batch]
            values = pa.array(np.array(rows, np.float32).ravel())
            yield lists(values, [STATISTICS] * len(rows))

    measure.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(measure, "array<float>")(utf8(text))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@dataclass(frozen=True)
class Scale:
    """Mean and inverse deviation of each statistic, and the projection to Fourier features."""

    mean: np.ndarray
    inverse: np.ndarray
    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def of(cls, n: int, total: np.ndarray, squares: np.ndarray, features: int, width: float,
           seed: int) -> Scale:
        mean = total / n
        deviation = np.sqrt(np.maximum(squares / n - mean ** 2, 0))
        random = np.random.default_rng(seed)
        weights = random.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        return cls(mean, np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0), weights,
                   random.uniform(0, 2 * np.pi, features))

    def features(self, statistics_: np.ndarray) -> np.ndarray:
        """Fourier features of rows, and a constant."""
        x = np.clip((statistics_ - self.mean) * self.inverse, -8, 8) @ self.weights + self.shifts
        return np.hstack([np.sqrt(2 / x.shape[1]) * np.cos(x), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    """Scores statistics; `at` and `share` are the knots of the calibration."""

    scale: Scale | None
    ridge: np.ndarray
    at: np.ndarray
    share: np.ndarray

    def raw(self, statistics_: np.ndarray) -> np.ndarray:
        return self.scale.features(statistics_) @ self.ridge

    def scores(self, statistics_: np.ndarray) -> np.ndarray:
        if self.scale is None:
            return np.ones(len(statistics_))
        return np.clip(np.interp(self.raw(statistics_), self.at, self.share), 0.0, 1.0)

    def score(self, statistics_: Column) -> Column:
        """Share of good documents among those of this score, by array of statistics."""
        return _scored(self.scores, statistics_)


def _scored(work, column: Column) -> Column:
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(work(_rows(batch)) if len(batch) else [], pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double")(column)


def _summed(rows: DataFrame, work) -> np.ndarray | None:
    """Sum over all batches of the array that `work` makes of (statistics, labels)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                part = work(_rows(batch.column("statistics")), labels)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [_add(group["part"])]})

    sums = rows.mapInArrow(parts, "part binary").groupBy(
        F.pmod(F.xxhash64("part"), F.lit(SUMS)).alias("slot")).applyInPandas(add, "part binary")
    found = [row[0] for row in sums.collect()]
    return np.frombuffer(_add(found)) if found else None


def _add(parts) -> bytes:
    total = 0.0
    for part in parts:
        total = total + np.frombuffer(part)
    return total.tobytes()


def pool_adjacent(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Isotonic means of bins in order, given their counts and sums of labels."""
    blocks: list[list[float]] = []
    for n, total in zip(counts, sums):
        blocks.append([n, total, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n_, total_, width = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n_, blocks[-1][1] + total_, blocks[-1][2] + width]
    return np.concatenate([np.full(width, total / n) for n, total, width in blocks])


def fit(rows: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE,
        seed: int = 7) -> Model:
    """Model of `rows` with `statistics` and `label` (0 or 1); `rows` is read three times."""
    k = STATISTICS
    sums = _summed(rows, lambda x, y: np.concatenate(
        [[len(y)], x.sum(0), (x * x).sum(0)]))
    if sums is None:
        return Model(None, *[np.empty(0)] * 3)
    scale = Scale.of(int(sums[0]), sums[1:k + 1], sums[k + 1:], features, width, seed)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = scale.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _summed(rows, normal)
    d = features + 1
    gram, right = sums[:d * d].reshape(d, d), sums[d * d:]
    penalty = ridge * gram[-1, -1] * np.append(np.ones(features) / features, 0.0)
    weights = np.linalg.lstsq(gram + np.diag(penalty), right, rcond=None)[0]
    raw = Model(scale, weights, np.empty(0), np.empty(0)).raw

    place = F.floor((F.least(F.greatest(_scored(raw, F.col("statistics")), F.lit(-1.0)),
                             F.lit(1.9999)) + 1) / 3 * BINS)
    bins = rows.select(place.alias("bin"), "label").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("bin").collect()
    at = np.array([(row["bin"] + 0.5) * 3 / BINS - 1 for row in bins])
    return Model(scale, weights, at, pool_adjacent(
        np.array([float(row["n"]) for row in bins]),
        np.array([float(row["good"]) for row in bins])))


def is_held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id",
             label_col: str = "quality") -> DataFrame:
    """Statistics and labels of the documents to learn from; `rows` has the id and statistics."""
    key = F.col(f"`{id_col}`")
    marks = labels.filter(F.col(f"`{label_col}`").isNotNull()).groupBy(key.alias("_id")).agg(
        F.min(f"`{label_col}`").alias("label"))
    return rows.filter(~is_held_out(key)).select(key.alias("_id"), "statistics").join(
        marks, "_id").select("statistics", "label")
