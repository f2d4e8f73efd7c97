"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. Each task counts scores in bins of
its queries' current ranges; the counts are summed over all tasks, the bin that holds the k-th
score becomes the next range, and so on until a bin is one score wide: the exact k-th score of each
query. A last pass takes the scores above it and, of its ties, the smallest ids.

A task reports only bins down to its own k-th score: the k-th of all is never below that of any
part, so lower bins cannot hold it. Likewise it hands over only its k smallest ties. Results never
depend on how rows fall into blocks, and nothing but counts and winners is shuffled.

Vectors that are null or hold a null or non-finite component, and rows without an id, take no part.
Vectors meet those of the same length only. Rows with a query's id are its own and no candidates;
a repeated query id is asked once, with the smallest of its vectors; repeated candidates are listed
as often as they occur. Inner products must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import stage

BIN_BITS = 10
#: Rows of a block: 2 MB at 64 components.
BLOCK = 4096
#: Queries that a task scores at once against a block of candidates.
_AT_ONCE = 512
_LOWEST = -(1 << 62)
_EXACT = 2.0 ** 53


def whole_units(vector: Column, unit: float) -> Column:
    """Components as whole numbers of 1/unit, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * unit))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(values: pa.StructArray, name: str = "vec") -> np.ndarray:
    lists = values.field(name)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1) if len(flat) else np.zeros((len(values), 0), np.int64)


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point while every sum is far below 2**53."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(candidates).max()) * queries.shape[1]
    if most < _EXACT:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    return queries @ candidates.T


def _pairs(batches: Iterator[pa.RecordBatch]):
    """(query numbers, query fields, candidate ids, scores) of each meeting of two blocks.

    A query's own rows get the lowest score.
    """
    for batch in batches:
        for row in range(batch.num_rows):
            asked = batch.column("asked").slice(row, 1).flatten()
            held = batch.column("held").slice(row, 1).flatten()
            ids, candidates = held.field("id").to_numpy(), _matrix(held)
            for at in range(0, len(asked), _AT_ONCE):
                part = asked.slice(at, _AT_ONCE)
                query = {name: part.field(name).to_numpy() for name in ("id", "low", "need")}
                scores = _scores(_matrix(part), candidates)
                scores[query["id"][:, None] == ids[None, :]] = _LOWEST
                yield query, ids, scores


def _at_least(scores: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The `need`-th highest score of each row, the lowest where there are fewer."""
    most = min(int(need.max()), scores.shape[1])
    top = -np.sort(-np.partition(scores, scores.shape[1] - most, axis=1)[:, -most:], axis=1)
    at = np.minimum(need, most) - 1
    return np.where(need > most, _LOWEST, top[np.arange(len(top)), at])


def _histograms(shift: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, _, scores in _pairs(batches):
            low, high = query["low"], query["low"] + (1 << (shift + BIN_BITS))
            scores = np.where((scores >= low[:, None]) & (scores < high[:, None]), scores, _LOWEST)
            cut = np.maximum(_at_least(scores, query["need"]), low)
            cut = low + ((cut - low) >> shift << shift)
            q, c = np.nonzero(scores >= cut[:, None])
            bins = (scores[q, c] - low[q]) >> shift
            keys, counts = np.unique((q << BIN_BITS) + bins, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query["id"][keys >> BIN_BITS]),
                 pa.array(keys & ((1 << BIN_BITS) - 1)), pa.array(counts)], ["id", "bin", "n"])

    return count


def _winners(k: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, ids, scores in _pairs(batches):
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], scores[:, order]
            low = np.maximum(query["low"], _LOWEST + 1)[:, None]
            tied = scores == low
            q, c = np.nonzero((scores > low) | (tied & (np.cumsum(tied, axis=1) <= k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(query["id"][q]), pa.array(ids[c]), pa.array(scores[q, c])],
                ["query_id", "vec_id", "score"])

    return take


def _blocks(rows: DataFrame, count: int, *fields: str) -> DataFrame:
    """Rows dealt evenly into `count` blocks per vector length."""
    return rows.withColumn("block", F.floor(F.col("draw") * count).cast("int")).groupBy(
        "dim", "block").agg(F.collect_list(F.struct(*fields)).alias("rows"))


def top_k(vectors: DataFrame, is_query: Column, k: int, unit: float, id_col: str = "vec_id",
          vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k highest inner products of each query: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`")
    rows = vectors.filter(usable(vector) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), whole_units(vector, unit).alias("vec"),
        is_query.alias("asks"))
    rows = stage(rows.select("*", F.size("vec").alias("dim"), F.rand(6).alias("draw")), "vectors")
    asked = rows.filter("asks").groupBy("id").agg(F.min("vec").alias("vec"), F.min("draw").alias(
        "draw")).withColumn("dim", F.size("vec"))

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x))
    n, longest = rows.agg(F.count("*"), F.max(norm)).first()
    asking = asked.count()
    held = _blocks(rows, max(1, ceil(n / block)), "id", "vec")
    columns = max(1, min(ceil(n / block), spark.sparkContext.defaultParallelism))
    groups = max(1, ceil(asking / block))
    held = stage(held.select(
        "dim", F.pmod("block", F.lit(columns)).alias("column"), F.col("rows").alias("held")),
        "held").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    # Every score lies within the product of the longest vector's norm with itself.
    bits = max(1, int(2 * (longest or 0) ** 2 + 2).bit_length())
    rounds = ceil(bits / BIN_BITS)
    state = asked.withColumns({"low": F.lit(-(1 << (rounds * BIN_BITS - 1))),
                               "need": F.lit(k).cast("long")})

    def meetings(queries: DataFrame) -> DataFrame:
        groups_ = _blocks(queries, groups, "id", "vec", "low", "need").select(
            "dim", F.col("block").alias("group"), F.col("rows").alias("asked"),
            F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
        return held.join(groups_, ["dim", "group", "column"]).select("asked", "held")

    state = stage(state, "queries")
    for step in range(rounds):
        shift = (rounds - 1 - step) * BIN_BITS
        open_ = state.filter(F.col("low") > _LOWEST)
        bins = meetings(open_).mapInArrow(_histograms(shift), "id long, bin long, n long")
        bins = bins.groupBy("id", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("id").orderBy(F.desc("bin"))
        bins = bins.withColumn("so_far", F.sum("n").over(above))
        found = bins.join(open_.select("id", "low", "need"), "id").filter(
            (F.col("so_far") >= F.col("need")) & (F.col("so_far") - F.col("n") < F.col("need")))
        found = found.select("id", (F.col("low") + F.col("bin") * (1 << shift)).alias("next"),
                             (F.col("need") - F.col("so_far") + F.col("n")).alias("rest"))
        # A query without a k-th score has fewer candidates than k, and takes them all.
        state = stage(state.join(found, "id", "left").select(
            "id", "vec", "draw", "dim", F.coalesce("next", F.lit(_LOWEST)).alias("low"),
            F.coalesce("rest", F.lit(k)).alias("need")), "queries")
    best = meetings(state).mapInArrow(_winners(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
