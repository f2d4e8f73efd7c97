"""Exact substring dedup with sorted suffixes.

Every byte covered by a string of `LENGTH` bytes that also starts anywhere else is removed.

Sorting all suffixes of a corpus would move every byte hundreds of times. Anchors make a sparse
suffix array do: of the grams in each window of `LENGTH` bytes the one with the least hash is an
anchor, so equal windows have equal anchors at equal places, and anchors are under one per cent of
all positions. Only anchors whose gram occurs twice go on. The suffixes from such anchors, and the
bytes before them read backwards, are sorted by deep-shallow sorting; common prefixes along both
orders tell exactly which strings around an anchor repeat.

Occurrences with equal contexts are one entry with a count, so copies cost nothing. A gram with
more distinct contexts than one task should sort (`SORTED`) takes another exact way: its strings
are counted by digest, a plain aggregate.

Strings never cross documents. A null text is empty; texts shorter than `LENGTH` keep all bytes.
Repeated rows, with or without an id, are copies like others. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import lists, packed, unpacked, utf8
from runlens.llm.suffix_sort import repeated_offsets
from runlens.session import stage

LENGTH = 400
GRAM = 128
#: Contexts of a gram that one task sorts: some 14 MB.
SORTED = 20_000
#: Contexts that a worker gathers before it hands them on.
_HELD = 20_000
_PIECE = 1 << 20
_PLACE = (1 << 21) - 1
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POWERS = _powers(_BASE, _PIECE)
_INVERSES = _powers(pow(_BASE, -1, 1 << 64), _PIECE)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hashes of all grams, by sums of bytes times powers modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[:len(data)], out=sums[1:])
    found = (sums[gram:] - sums[:-gram]) * _INVERSES[:len(data) - gram + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29))


def _window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """Least key of each window, from minima up to and from the edges of blocks."""
    n = len(keys) - window + 1
    blocks = np.full(-(-len(keys) // window) * window, _MASK, np.uint64)
    blocks[:len(keys)] = keys
    blocks = blocks.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[window - 1:window - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and the hashes of their grams; the last of equal ones in a window."""
    window, places, hashes = length - gram + 1, [], []
    for start in range(0, max(1, len(data) - length + 1), _PIECE - length + 1):
        piece = np.frombuffer(data, np.uint8)[start:start + _PIECE]
        if len(piece) < length:
            break
        found = _gram_hashes(piece, gram)
        keys = (found & np.uint64(_MASK ^ _PLACE)) | (
            np.uint64(_PLACE) - np.arange(len(found), dtype=np.uint64))
        at = _PLACE - (np.unique(_window_minima(keys, window)) & np.uint64(_PLACE)).astype(np.int64)
        places.append(at + start)
        hashes.append(found[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes).view(np.int64)[first]


def _anchored(data: Column, length: int, gram: int) -> Column:
    kind = pa.struct([("at", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [anchors(text.as_py(), length, gram) for text in batch]
            sizes = [len(at) for at, _ in found]
            columns = [np.concatenate([row[i] for row in found]) if found else [] for i in (0, 1)]
            yield pa.StructArray.from_arrays(
                [lists(pa.array(columns[0], pa.int32()), sizes),
                 lists(pa.array(columns[1], pa.int64()), sizes)], fields=list(kind))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "struct<at:array<int>,gram:array<bigint>>")(data)


def _contexts(data: bytes, at: int, length: int, gram: int) -> tuple[bytes, bytes, bytes]:
    """Digest of an anchor's context, the bytes before it read backwards, and those from it."""
    before = data[max(0, at - length + gram):at][::-1]
    after = data[at:at + length]
    return xxhash.xxh3_128_digest(b"%d " % len(before) + before + after), before, after


_HIT = "key binary, at int, gram long, context binary"
_CONTEXT = "gram long, context binary, before binary, after binary, n long"


def _rows_of(batch: pa.RecordBatch):
    for row in batch.to_pylist():
        yield row["key"], row["data"], row["n"], row["hits"]


def _places(length: int, gram: int):
    """Every anchor of a text with the digest of its context."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, hit["at"], hit["gram"], _contexts(data, hit["at"], length, gram)[0])
                   for key, data, _, hits in _rows_of(batch) for hit in hits]
            yield _batch(out, [("key", pa.binary()), ("at", pa.int32()), ("gram", pa.int64()),
                               ("context", pa.binary())])

    return work


def _distinct_contexts(length: int, gram: int):
    """The contexts of neighbouring texts, equal ones as one row with their count."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for _, data, n, hits in _rows_of(batch):
                for hit in hits:
                    digest, before, after = _contexts(data, hit["at"], length, gram)
                    entry = found.setdefault((hit["gram"], digest), [before, after, 0])
                    entry[2] += n
                if len(found) >= _HELD:
                    yield _batch([(*key, *entry) for key, entry in found.items()], _CONTEXT_FIELDS)
                    found = {}
            yield _batch([(*key, *entry) for key, entry in found.items()], _CONTEXT_FIELDS)

    return work


_CONTEXT_FIELDS = [("gram", pa.int64()), ("context", pa.binary()), ("before", pa.binary()),
                   ("after", pa.binary()), ("n", pa.int64())]
_OFFSET_FIELDS = [("context", pa.binary()), ("least", pa.int32()), ("greatest", pa.int32())]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)],
        schema=pa.schema(fields))


def _sorted_offsets(length: int, gram: int):
    """Offsets of repeated strings; rows come sorted by gram and context."""
    def solve(group: list) -> Iterator[tuple]:
        if len(group) > 1 or group[0][3] > 1:
            digests, befores, afters, counts = zip(*group)
            found = repeated_offsets(befores, afters, counts, length, length - gram)
            for digest, offsets in zip(digests, found):
                if offsets:
                    yield digest, *offsets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        for batch in batches:
            out = []
            for grams, digest, before, after, n in zip(
                    *[batch.column(name).to_pylist() for name, _ in _CONTEXT_FIELDS]):
                if grams != current:
                    if group:
                        out += solve(group)
                    current, group = grams, []
                if group and group[-1][0] == digest:
                    group[-1] = (*group[-1][:3], group[-1][3] + n)
                else:
                    group.append((digest, before, after, n))
            yield _batch(out, _OFFSET_FIELDS)
        yield _batch(list(solve(group)) if group else [], _OFFSET_FIELDS)

    return work


def _strings(length: int, gram: int):
    """Digest of every string around an anchor."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("digest", pa.binary()), ("context", pa.binary()), ("d", pa.int32()),
                  ("n", pa.int64())]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole = row["before"][::-1] + row["after"]
                at = len(row["before"])
                for start in range(0, len(whole) - length + 1):
                    out.append((xxhash.xxh3_128_digest(whole[start:start + length]),
                                row["context"], at - start, row["n"]))
                if len(out) > 50_000:
                    yield _batch(out, fields)
                    out = []
            yield _batch(out, fields)

    return work


def _counted_offsets(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The exact way for grams with too many contexts to sort: count strings by digest.

    Contexts of neighbouring anchors overlap, so a string counts with its offset to the anchor: one
    place holds a gram at one offset only once.
    """
    distinct = contexts.groupBy("gram", "context").agg(
        F.first("before").alias("before"), F.first("after").alias("after"), F.sum("n").alias("n"))
    strings = stage(distinct.mapInArrow(
        _strings(length, gram), "digest binary, context binary, d int, n long"), "strings")
    twice = strings.groupBy("digest", "d").agg(F.sum("n").alias("times")).filter("times > 1")
    return strings.join(twice, ["digest", "d"], "left_semi").groupBy("context").agg(
        F.min("d").alias("least"), F.max("d").alias("greatest"))


def _cut(data: Column, spans: Column) -> Column:
    """Bytes outside of all spans, how many were removed, and in how many runs."""
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists_ in batches:
            out = [without(text.as_py(), [(span["a"], span["b"]) for span in found.as_py()])
                   for text, found in zip(texts, lists_)]
            columns = zip(*out) if out else [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    columns, (pa.binary(), pa.int64(), pa.int64()))],
                ["kept", "n_removed", "n_spans"])

    cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]],
                           "return": Iterator[pa.Array]}
    return F.arrow_udf(cut, "struct<kept:binary,n_removed:bigint,n_spans:bigint>")(data, spans)


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """Bytes outside of the spans, the number removed, and the number of maximal runs removed."""
    kept, end, runs = [], 0, 0
    for a, b in sorted(spans):
        if a > end or not runs:
            kept.append(data[end:a])
            runs += 1
        end = max(end, b)
    kept.append(data[end:])
    kept_ = b"".join(kept)
    return kept_, len(data) - len(kept_), runs


def text_key(text: Column) -> Column:
    """Digest that stands for a whole text."""
    return F.unhex(F.md5(utf8(text)))


def repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
            sorted_: int = SORTED) -> DataFrame:
    """Of each different text that loses bytes: key, kept (bytes), n_removed, n_spans.

    `key` is `text_key` of the text.
    """
    text = F.col(f"`{text_col}`")
    found = stage(docs.filter(F.octet_length(text) >= length).select(
        text_key(text).alias("key"), _anchored(utf8(text), length, gram).alias("a")), "anchors")
    each = F.explode(F.arrays_zip(F.col("a.at").alias("at"), F.col("a.gram").alias("gram")))
    twice = found.select(F.explode("a.gram").alias("gram")).groupBy("gram").agg(
        F.count("*").alias("times")).filter("times > 1")
    hits = found.groupBy("key").agg(F.first("a").alias("a")).select("key", each.alias("hit")).select(
        "key", "hit.at", "hit.gram").join(twice, "gram", "left_semi")
    hits = hits.groupBy("key").agg(F.collect_list(F.struct("at", "gram")).alias("hits"))
    texts = docs.filter(F.octet_length(text) >= length).groupBy(text_key(text).alias("key")).agg(
        F.first(text).cast("binary").alias("data"), F.count("*").alias("n"))
    touched = stage(texts.join(hits, "key").select("key", "data", "n", "hits"), "touched")

    places = stage(touched.mapInArrow(_places(length, gram), _HIT), "places")
    hot = stage(places.select("gram", "context").distinct().groupBy("gram").count().filter(
        F.col("count") > sorted_).select("gram"), "hot")
    contexts = touched.mapInArrow(_distinct_contexts(length, gram), _CONTEXT)
    few = contexts.join(hot, "gram", "left_anti")
    offsets = few.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(
        _sorted_offsets(length, gram), "context binary, least int, greatest int")
    if not hot.isEmpty():
        many = contexts.join(hot, "gram", "left_semi")
        offsets = offsets.unionByName(_counted_offsets(many, length, gram))
    spans = places.join(stage(offsets, "offsets"), "context").select("key", F.struct(
        (F.col("at") - F.col("greatest")).alias("a"),
        (F.col("at") - F.col("least") + length).alias("b")).alias("span"))
    spans = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    return touched.select("key", "data").join(spans, "key").select(
        "key", _cut(F.col("data"), F.col("spans")).alias("cut")).select("key", "cut.*")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows of `docs` with the removed bytes cut out of their texts, and `n_removed`.

    Where a cut splits a character, what is left of it is dropped too.
    """
    text = F.col(f"`{text_col}`")
    cuts = stage(repeats(docs, text_col, length), "cuts")
    rows = packed(docs, key=F.when(F.octet_length(text) >= length, text_key(text)), text=text)
    joined = rows.join(cuts, "key", "left")
    whole = F.coalesce(_whole_characters(F.col("kept")), F.col("text"))
    return unpacked(joined, **{text_col: whole, "n_removed": F.coalesce("n_removed", F.lit(0))})


def _whole_characters(data: Column) -> Column:
    """Text of bytes without the incomplete characters."""
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else x.decode("utf-8", "ignore")
                            for x in batch.to_pylist()], pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string")(data)
