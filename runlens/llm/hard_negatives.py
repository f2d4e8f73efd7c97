"""Hard-negative mining with Kronecker-packed inner products.

An anchor's positives are its nearest rows of the same label. Its hard negatives, for each positive,
are the nearest rows of other labels whose score lies between two shares of the positive's score.

Every score is exact. Components are whole numbers; both sides are biased so that none is negative,
and the biased components of several candidates are set into separate fields of one wide integer.
One multiplication per anchor component then serves all candidates of the integer, as a field is
wide enough for the largest sum it can reach and no carry leaves it. Unpacking takes the fields out
and the biases off again. Fields share a machine word where at least one fits, else an integer of
any width.

All rows are dealt at random into blocks, so no label, however common, is one task's work. A task
scores a block of anchors against the blocks of one column of candidates and keeps only the best
rows of each anchor, or of each positive, over all of them. Nothing but these is shuffled.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors
meet those of the same length only. Rows with an anchor's id are its own and no candidates; an
anchor id that occurs several times is asked once, with the smallest of its (label, vector). Other
repeated rows count as often as they occur: a repeated positive is listed again, each time with all
its negatives. Ties go to the smaller id, or, for one id, to whichever row, as these look the same
in the result. Inner products must fit a long. Empty tables give no rows, other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.topk import usable, whole_units
from runlens.session import stage

#: Rows of a block: 2 MB at 64 components.
BLOCK = 4096
#: Blocks of candidates that a task scores one after the other against a block of anchors.
COLUMN = 64
#: Bits of a machine word that fields may take; the sign stays clear.
WORD_BITS = 63
#: Columns that few blocks are still spread over, for the tasks' sake.
SPREAD = 64
#: Anchors scored at once against a block of candidates.
AT_ONCE = 256


@dataclass(frozen=True)
class Packed:
    """Candidates' biased components, several candidates to a wide integer: (component, integer)."""

    words: np.ndarray
    fields: int
    width: int
    n: int
    bias: int
    sums: np.ndarray


def field_width(anchors: np.ndarray, candidates: np.ndarray) -> int:
    """Bits that hold every inner product of the biased rows, by the inequality of Cauchy."""
    def longest(rows: np.ndarray) -> float:
        return float(np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max(initial=0.0))

    return max(1, int(longest(anchors) * longest(candidates) * (1 + 1e-9) + 1).bit_length())


def biased(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows less their smallest component where that is negative, and the bias."""
    bias = -min(0, int(rows.min(initial=0)))
    return rows + bias, bias


def packed(candidates: np.ndarray, width: int) -> Packed:
    """Pack rows into fields of `width` bits; the last integer may have empty fields."""
    shifted, bias = biased(candidates)
    n, dim = shifted.shape
    fields = WORD_BITS // width
    kind = np.int64
    if not fields:  # wider than a machine word: integers of any width, eight fields each
        fields, kind = 8, object
    padded = np.zeros((-(-n // fields) * fields, dim), np.int64)
    padded[:n] = shifted
    words = np.zeros((dim, len(padded) // fields), kind)
    for field in range(fields):
        column = padded[field::fields].T.astype(kind)
        words = words + (column << width * field if kind is np.int64 else column * (
            1 << width * field))
    return Packed(words, fields, width, n, bias, candidates.sum(axis=1))


def scores(anchors: np.ndarray, candidates: Packed) -> np.ndarray:
    """Exact inner products of anchors (rows) and packed candidates (columns)."""
    shifted, bias = biased(anchors)
    dim = anchors.shape[1]
    sums = shifted.astype(candidates.words.dtype) @ candidates.words
    out = np.zeros((len(anchors), sums.shape[1] * candidates.fields), np.int64)
    mask = (1 << candidates.width) - 1
    # What the biases added: to the anchors over the candidate, to the candidate over the anchors.
    own = shifted.sum(axis=1)[:, None] * candidates.bias
    other = np.zeros(out.shape[1], np.int64)
    other[:candidates.n] = candidates.sums * bias
    for field in range(candidates.fields):
        at = slice(field, None, candidates.fields)
        out[:, at] = (sums >> candidates.width * field & mask) - own - other[at]
    return out[:, :candidates.n] if dim else np.zeros((len(anchors), candidates.n), np.int64)


def _matrix(rows: pa.StructArray) -> np.ndarray:
    vectors = rows.field("vec")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(flat) else np.zeros((len(rows), 0), np.int64)


def product_blocks(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[
        tuple[int, np.ndarray]]:
    """(first anchor, scores) of consecutive parts of the anchors against all candidates."""
    width = field_width(biased(anchors)[0], biased(candidates)[0])
    held = packed(candidates, width)
    for at in range(0, len(anchors), AT_ONCE):
        yield at, scores(anchors[at:at + AT_ONCE], held)


class Best:
    """The best `k` (score, id) of each of `n` lists, and the score that a new one must reach."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = [np.empty(0, np.int64)] * n
        self.id = [np.empty(0, np.int64)] * n
        self.least = np.full(n, np.iinfo(np.int64).min)

    def add(self, at: int, score: np.ndarray, id_: np.ndarray) -> None:
        score = np.concatenate([self.score[at], score])
        id_ = np.concatenate([self.id[at], id_])
        order = np.lexsort((id_, -score))[:self.k]
        self.score[at], self.id[at] = score[order], id_[order]
        if len(order) == self.k:
            self.least[at] = score[order[-1]]


def _meetings(batches: Iterator[pa.RecordBatch]):
    """(key, anchors, candidates) of each meeting of an anchor block and a candidate block."""
    for batch in batches:
        keys = list(zip(*[batch.column(name).to_pylist() for name in ("dim", "group", "column")]))
        for row, key in enumerate(keys):
            yield (key, batch.column("asked").slice(row, 1).flatten(),
                   batch.column("held").slice(row, 1).flatten())


def _mined(batches: Iterator[pa.RecordBatch], lists_of, visit) -> Iterator[pa.RecordBatch]:
    """Best rows per list over all meetings of one anchor block that follow one another."""
    now = state = None
    for key, anchors, candidates in _meetings(batches):
        if key != now:
            if state:
                yield from _handed(state)
            now, state = key, lists_of(anchors)
        visit(state, anchors, candidates)
    if state:
        yield from _handed(state)


def _handed(state) -> Iterator[pa.RecordBatch]:
    best, names, lists = state
    sizes = [len(ids) for ids in best.id]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(np.repeat(column, sizes)) for column in lists],
             pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))],
            [*names, "id", "score"])


def _positives(k: int):
    """The k nearest rows of the same label of each anchor, over the blocks of a column."""

    def lists_of(anchors: pa.StructArray):
        ids = anchors.field("id").to_numpy()
        return Best(len(ids), k), ["anchor_id"], [ids]

    def visit(state, anchors: pa.StructArray, candidates: pa.StructArray) -> None:
        best, _, (ids,) = state
        labels = anchors.field("label").to_numpy()
        other, theirs = candidates.field("id").to_numpy(), candidates.field("label").to_numpy()
        for at, part in product_blocks(_matrix(anchors), _matrix(candidates)):
            end = at + len(part)
            fits = (labels[at:end, None] == theirs) & (ids[at:end, None] != other) & (
                part >= best.least[at:end, None])
            for row in np.flatnonzero(fits.any(axis=1)):
                found = np.flatnonzero(fits[row])
                best.add(at + row, part[row, found], other[found])

    return lambda batches: _mined(batches, lists_of, visit)


def _negatives(k: int, low: int, high: int):
    """The k nearest rows of other labels within the window of each positive of each anchor."""

    def lists_of(anchors: pa.StructArray):
        kept = anchors.field("positives")
        sizes = np.diff(kept.offsets.to_numpy())
        flat = kept.flatten()
        score = flat.field("score").to_numpy()
        names = ["anchor_id", "no", "positive_id", "positive_score"]
        lists = [np.repeat(anchors.field("id").to_numpy(), sizes), flat.field("no").to_numpy(),
                 flat.field("id").to_numpy(), score]
        best = Best(len(score), k)
        # Scores are whole numbers, so the window's ends are too.
        best.least = -(-low * score // 100)
        best.most = high * score // 100
        best.first = np.concatenate([[0], np.cumsum(sizes)])
        return best, names, lists

    def visit(state, anchors: pa.StructArray, candidates: pa.StructArray) -> None:
        best = state[0]
        labels, ids = anchors.field("label").to_numpy(), anchors.field("id").to_numpy()
        other, theirs = candidates.field("id").to_numpy(), candidates.field("label").to_numpy()
        for at, part in product_blocks(_matrix(anchors), _matrix(candidates)):
            for row in range(len(part)):
                first, end = best.first[at + row], best.first[at + row + 1]
                if first == end:
                    continue
                score = part[row]
                found = np.flatnonzero(
                    (score >= best.least[first:end].min()) & (score <= best.most[first:end].max())
                    & (theirs != labels[at + row]) & (other != ids[at + row]))
                if not len(found):
                    continue
                found = found[np.lexsort((other[found], -score[found]))]
                falling = -score[found]
                starts = np.searchsorted(falling, -best.most[first:end], "left")
                ends = np.searchsorted(falling, -best.least[first:end], "right")
                for one, start, stop in zip(range(first, end), starts, ends):
                    if start < stop:
                        hit = found[start:min(stop, start + best.k)]
                        best.add(one, score[hit], other[hit])

    return lambda batches: _mined(batches, lists_of, visit)


def _blocks(rows: DataFrame, count: int, *fields: str) -> DataFrame:
    """Rows dealt evenly into `count` blocks per vector length."""
    return rows.withColumn("block", F.floor(F.col("draw") * count).cast("int")).groupBy(
        "dim", "block").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, unit: float,
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
                   column: int = COLUMN) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative of score n belongs to a positive of score p if low * p <= 100 * n <= high * p.
    `unit` is what one stands for in whole units.
    """
    vector, key = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    rows = vectors.filter(usable(vector) & key.isNotNull() & label.isNotNull()).select(
        key.cast("long").alias("id"), label.cast("long").alias("label"),
        whole_units(vector, unit).alias("vec"), is_anchor.alias("asks"))
    rows = stage(rows.select("*", F.size("vec").alias("dim"), F.rand(11).alias("draw")), "vectors")
    asked = rows.filter("asks").groupBy("id").agg(F.min(F.struct(
        "label", "vec", "dim", "draw")).alias("own")).select("id", "own.*")

    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("anchors")).first()
    blocks = max(1, ceil(counts["n"] / block))
    columns = max(ceil(blocks / column), min(blocks, SPREAD))
    groups = max(1, ceil(counts["anchors"] / block))
    held = stage(_blocks(rows, blocks, "id", "label", "vec").select(
        "dim", F.pmod("block", F.lit(columns)).alias("column"), F.col("rows").alias("held")),
        "held").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meetings(anchors: DataFrame, *fields: str) -> DataFrame:
        grouped = _blocks(anchors, groups, "id", "label", "vec", *fields).select(
            "dim", F.col("block").alias("group"), F.col("rows").alias("asked"),
            F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
        return held.join(grouped, ["dim", "group", "column"]).select(
            "dim", "group", "column", "asked", "held")

    def best(found: DataFrame, k: int, *lists: str) -> DataFrame:
        order = Window.partitionBy(*lists).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(
            F.col("rank") <= k)

    near = meetings(asked).mapInArrow(_positives(positives), "anchor_id long, id long, score long")
    near = best(near, positives, "anchor_id").groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("no"), "id", "score"))).alias(
            "positives"))
    asking = stage(asked.join(near, "id"), "anchors")
    far = meetings(asking, "positives").mapInArrow(
        _negatives(negatives, low, high), "anchor_id long, no int, positive_id long, "
        "positive_score long, id long, score long")
    return best(far, negatives, "anchor_id", "no").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
