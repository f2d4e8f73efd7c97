"""SimHash near-duplicates by multi-index hashing.

A fingerprint's bit is set if it is set in more than half of the hashes of the text's shingles.
Fingerprints are cut into segments, and a table knows each under the value of every segment. Of two
fingerprints within `max_bits` bits, one segment differs in at most `max_bits // segments` bits; so
each fingerprint looks into the table under all values in the small Hamming ball around each of its
segments, fetches what is there, and the complete distance decides. Components of the links are the
groups.

A segment value that more than `CROWDED` different fingerprints share, as in a huge group of near
copies, would be fetched by as many: the square of their number. Fingerprints that look there are
linked in another exact way: each is entered under all values half-way to a neighbour, of which an
entry never holds more than a ball has points, and is linked to the nearest in its entry.

A null or empty text, or one of white space only, has the fingerprint zero, linked like any other.
Equal fingerprints are one node, so copies cost nothing. Rows without an id take part and never name
a group: a group of such rows only has a null `component_id`. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import packed, unpacked, utf8
from runlens.llm.components import components
from runlens.session import stage

SHINGLE = 3
MAX_BITS = 2
#: Segments of a fingerprint. Two of 32 bits: a random value is shared by few in any corpus.
SEGMENTS = 2
#: Different fingerprints that may share a segment's value and still be fetched one by one.
CROWDED = 1000
SEED = 42
_BITS = 64
_AT_ONCE = 1 << 15


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text, as a signed 64-bit integer."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = [end - 1 for end in accumulate([len(word) + 1 for word in words])]
    starts = [0, *[end + 1 for end in ends]]
    ends = ends[shingle - 1:] or ends[-1:]
    set_in = np.zeros(_BITS, np.int64)
    for at in range(0, len(ends), _AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[at:at + _AT_ONCE], ends[at:at + _AT_ONCE])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * set_in > len(ends), bitorder="little").view(np.int64)
    return int(value[0])


def fingerprint(text: Column | str, shingle: int = SHINGLE) -> Column:
    """Fingerprints of whole texts, as signed longs."""

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([simhash(data.as_py(), shingle) for data in batch], pa.int64())

    prints.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(prints, "bigint")(utf8(text))


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    ends = [_BITS * at // segments for at in range(segments + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def ball(width: int, radius: int) -> list[int]:
    """Masks of all points of `width` bits within `radius` bits, as signed longs."""
    masks = [sum(1 << bit for bit in bits) for n in range(radius + 1)
             for bits in combinations(range(width), n)]
    return [mask - (1 << _BITS) if mask >> _BITS - 1 else mask for mask in masks]


def _segment_values(segments: int, radius: int) -> Column:
    """Array of (segment, value): all values within `radius` bits of each segment's own."""
    def values(at: int, first: int, width: int) -> Column:
        own = F.shiftrightunsigned("fp", first)
        if first + width < _BITS:
            own = own.bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(mask).cast("long") for mask in ball(width, radius)])
        return F.transform(masks, lambda mask: F.struct(
            F.lit(at).alias("segment"), own.bitwiseXOR(mask).alias("value")))

    return F.concat(*[values(at, *bounds) for at, bounds in enumerate(segment_bounds(segments))])


def segment_table(prints: DataFrame, segments: int = SEGMENTS, radius: int = 0) -> DataFrame:
    """(segment, value, fp): the index itself, or with a radius all that is looked up in it."""
    return prints.select("fp", F.explode(_segment_values(segments, radius)).alias("at")).select(
        "at.segment", "at.value", "fp")


def distance(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v)))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS,
               crowded: int = CROWDED) -> DataFrame:
    """Links (u, v) that connect all of the distinct fingerprints `fp` within `max_bits` bits."""
    index = segment_table(prints, segments)
    probes = segment_table(prints, segments, max_bits // segments)
    key = ["segment", "value"]
    full = stage(index.groupBy(*key).count().filter(F.col("count") > crowded).select(*key), "full")
    if full.isEmpty():
        return _verified(probes, index, max_bits)
    there = probes.join(full, key, "left_semi").select("fp").distinct()
    return _verified(probes, index.join(full, key, "left_anti"), max_bits).unionByName(
        half_way_links(there, max_bits)).distinct()


def _verified(probes: DataFrame, index: DataFrame, max_bits: int) -> DataFrame:
    """Fetched pairs whose complete distance is within the bound."""
    met = probes.withColumnRenamed("fp", "u").join(
        index.withColumnRenamed("fp", "v"), ["segment", "value"])
    return met.filter((F.col("u") < F.col("v")) & (distance("u", "v") <= max_bits)).select(
        "u", "v").distinct()


def half_way_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The same for fingerprints that crowd together, by links that only chain them."""
    masks = F.array(*[F.lit(mask).cast("long") for mask in ball(_BITS, (max_bits + 1) // 2)])
    table = prints.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("entry"),
        F.bit_count("mask").alias("far"))
    nearest = F.first("fp").over(Window.partitionBy("entry").orderBy("far", "fp"))
    met = table.select(F.col("fp").alias("u"), nearest.alias("v")).filter("u != v")
    return met.filter(distance("u", "v") <= max_bits).distinct()


def groups(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Of every distinct `fp` of (`id`, `fp`) rows: its `part` and `component_id`.

    `part` is the least fingerprint of the group, `component_id` its least id.
    """
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    linked = components(near_links(distinct, max_bits, segments))
    parts = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("component", "fp").alias("part"))
    return parts.drop("id").join(
        parts.groupBy("part").agg(F.min("id").alias("component_id")), "part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """`id_col`, `fp` and `component_id` of every row of `docs`."""
    prints = stage(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(
        F.col(f"`{text_col}`"), shingle).alias("fp")), "prints")
    found = prints.join(groups(prints, max_bits), "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: that of the least id, any of equally good ones."""
    print_ = fingerprint(F.col(f"`{text_col}`"), shingle)
    narrow = stage(docs.select(F.col(f"`{id_col}`").alias("id"), print_.alias("fp")), "prints")
    rows = narrow.join(groups(narrow, max_bits), "fp").filter(
        F.col("id").eqNullSafe(F.col("component_id")))
    best = rows.groupBy("part").agg(F.min("fp").alias("best"))
    chosen = stage(rows.join(best, "part").filter("fp = best").groupBy(
        F.struct("id", "fp").alias("key")).agg(F.count("*").alias("rows")), "chosen")
    kept = packed(docs, id=F.col(f"`{id_col}`"), fp=print_).withColumn(
        "key", F.struct("id", "fp")).join(chosen, "key")
    if chosen.filter("rows > 1").isEmpty():
        return unpacked(kept)
    return unpacked(kept.filter("rows = 1")).unionByName(
        unpacked(kept.filter("rows > 1").dropDuplicates(["id", "fp"])))


def hexadecimal(fp: Column) -> Column:
    """Fingerprint as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
