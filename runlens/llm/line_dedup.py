"""Line dedup by a deletion-neighbourhood join over words.

A line goes if an earlier one, anywhere in the corpus, has its words but for one at most: one word
exchanged, missing or added. A document is known by its id and a digest of its text; order is (id,
digest, line number), rows without an id last. Lines of fewer than `MIN_WORDS` words always stay; a
difference of a word is allowed from `NEAR_WORDS` words on.

All variants of a line that lack one word are emitted as hashed keys, which are made from running
sums in time and memory that grow with the line's words, not with their square. Lines that share a variant
with the same place left out differ in that word at most; a line that equals another's variant
lacks one word. Of each key only the earliest line is kept, so nothing is paired within a group,
and a removal counts after the edit distance to that line was verified.

Most lines have no near copy, and need no variants: lines within one word share their first or
last words up to the middle, so only lines that share such a half with another one go on. Equal
lines are one line with its earliest place throughout. Repeated rows (equal ids, or none, and equal
texts) are one document and keep the same lines; rows that share an id, or have none, but differ in
text are different documents. A null text has no lines, an empty one a single empty line; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import packed, unpacked, utf8
from runlens.session import stage

MIN_WORDS = 5
NEAR_WORDS = 8
#: Rows without an id come after all others.
_LAST = (1 << 63) - 1
#: What a document is known by, and a line of it; both sort as the lines do.
_DOC = ["doc", "key"]
_PLACE = [*_DOC, "no"]

_LINES = "array<struct<no:int,line:binary,halves:array<bigint>>>"
_LINE_TYPE = pa.list_(pa.struct([
    ("no", pa.int32()), ("line", pa.binary()), ("halves", pa.list_(pa.int64()))]))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def halves(words: list[bytes]) -> list[int]:
    """Keys of a line's first and last words up to the middle of the shorter line of a pair.

    The line may be the shorter one of a pair, or longer by a word: two sizes of halves when it
    has an even number of words, one otherwise.
    """
    n, found = len(words), []
    for size in {n // 2, (n - 1) // 2}:
        for side, half in ((0, words[:size]), (1, words[n - size:])):
            found.append(_signed(xxhash.xxh3_64_intdigest(b" ".join(half), side)))
    return found


def line_digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _line_keys(data: bytes, min_words: int, near_words: int) -> list[dict]:
    found = []
    for no, line in enumerate(data.split(b"\n")):
        words = line.split()
        if len(words) >= min_words:
            found.append({"no": no, "line": line_digest(words),
                          "halves": halves(words) if len(words) >= near_words else []})
    return found


def line_keys(text: Column | str, min_words: int, near_words: int) -> Column:
    """Lines of enough words: number, digest of the words, keys of the halves."""
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_line_keys(data.as_py(), min_words, near_words) for data in batch],
                           _LINE_TYPE)

    keys.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(keys, _LINES)(utf8(text))


def _factors(n: int) -> np.ndarray:
    """A fixed random odd number for each place in a line."""
    found = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found ^= found >> np.uint64(30)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(27)
    found *= np.uint64(0x94D049BB133111EB)
    return (found ^ (found >> np.uint64(31))) | np.uint64(1)


def variants(words: list[bytes]) -> np.ndarray:
    """Keys of the line, and of it without each word in turn.

    A key is the sum of the words' hashes times the factors of their places, modulo 2**64. So the
    keys of all variants come from two running sums: words ahead of the missing one stay in their
    places, those behind it move up by one.
    """
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    factors = _factors(n)
    ahead, behind = np.zeros(n + 1, np.uint64), np.zeros(max(n, 1), np.uint64)
    np.cumsum(hashes * factors, out=ahead[1:])
    np.cumsum(hashes[1:] * factors[:-1], out=behind[1:])
    return np.concatenate([ahead[-1:], ahead[:-1] + (behind[-1] - behind)]).view(np.int64)


_PLACE_FIELDS = [("doc", pa.int64()), ("key", pa.binary()), ("no", pa.int32())]
_VARIANT_FIELDS = [*_PLACE_FIELDS, ("variant", pa.int64()), ("at", pa.int32())]
_WORDS_FIELDS = [*_PLACE_FIELDS, ("words", pa.binary())]


def _table(rows: list[tuple], fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, (_, kind) in zip(columns, fields)],
        schema=pa.schema(fields))


def _emitted(batch: pa.RecordBatch, lines: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    """Places of the numbered lines, each beside all of its keys."""
    sizes = [len(some) for some in keys]
    places = batch.select(_PLACE).take(pa.array(np.repeat(lines, sizes)))
    return pa.RecordBatch.from_arrays(
        [*places.columns, pa.array(np.concatenate(keys)),
         pa.array(np.concatenate([np.arange(-1, size - 1, dtype=np.int32) for size in sizes]))],
        schema=pa.schema(_VARIANT_FIELDS))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of lines: the whole at place -1, others at that of the word they lack."""
    for batch in batches:
        lines, keys, held = [], [], 0
        for at, words in enumerate(batch.column("words")):
            lines.append(at)
            keys.append(variants(words.as_py().split()))
            held += len(keys[-1])
            if held > 50_000:
                yield _emitted(batch, lines, keys)
                lines, keys, held = [], [], 0
        if keys:
            yield _emitted(batch, lines, keys)


def within_one_word(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word is exchanged, missing or added."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def _verified(a: Column, b: Column) -> Column:
    def verify(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([within_one_word(x.split(), y.split()) for x, y in zip(
                left.to_pylist(), right.to_pylist())], pa.bool_())

    verify.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]],
                              "return": Iterator[pa.Array]}
    return F.arrow_udf(verify, "boolean")(a, b)


def _nth_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of chosen lines of each text."""
    for batch in batches:
        out = []
        for doc, key, data, numbers in zip(*[
                batch.column(name) for name in (*_DOC, "data", "nos")]):
            lines, doc, key = data.as_py().split(b"\n"), doc.as_py(), key.as_py()
            out += [(doc, key, no, b" ".join(lines[no].split())) for no in numbers.as_py()]
        yield _table(out, _WORDS_FIELDS)


def near_copies(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Places (doc, key, no) of lines with an earlier line of other words within one word.

    `docs` has `doc`, `key` and `data`; `firsts` the earliest place of each line, by which it is
    known from here on, and its halves.
    """
    half = firsts.select(*_PLACE, F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    wanted = half.join(shared, "half", "left_semi").groupBy(*_DOC).agg(
        F.collect_set("no").alias("nos"))
    words = stage(docs.join(wanted, _DOC).select(*_DOC, "data", "nos").mapInArrow(
        _nth_lines, "doc long, key binary, no int, words binary"), "words")
    emitted = stage(words.mapInArrow(
        _emit, "doc long, key binary, no int, variant long, at int"), "variants")

    place = F.struct(*_PLACE)
    exchanged = emitted.filter("at >= 0").groupBy("variant", "at").agg(
        F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = emitted.join(exchanged.select("variant", "at", "first"), ["variant", "at"])
    whole, less = F.when(F.col("at") < 0, place), F.when(F.col("at") >= 0, place)
    ends = emitted.groupBy("variant").agg(F.min(whole).alias("whole"), F.min(less).alias("less"))
    ends = ends.filter(F.col("whole").isNotNull() & F.col("less").isNotNull())
    missing = emitted.join(ends, "variant").withColumn(
        "first", F.when(F.col("at") < 0, F.col("less")).otherwise(F.col("whole")))
    met = stage(met.select(*_PLACE, "first").unionByName(
        missing.select(*_PLACE, "first")).filter(F.col("first") < place).distinct(), "met")

    # A removal counts after the distance between the words of both lines was verified.
    words = words.dropDuplicates(_PLACE)
    both = met.select(*_PLACE, *[F.col(f"first.{name}").alias(f"{name}_") for name in _PLACE]).join(
        words, _PLACE).join(words.select(
            *[F.col(name).alias(f"{name}_") for name in _PLACE], F.col("words").alias("other")),
            [f"{name}_" for name in _PLACE])
    return both.filter(_verified(F.col("words"), F.col("other"))).select(*_PLACE).distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Numbers of the lines each document loses: `doc`, `key` and array `removed`, from 0.

    `doc` is the id, or the largest long for rows without one; `key` is of the text.
    """
    rows = docs.select(_doc(id_col).alias("doc"), _key(id_col, text_col).alias("key"),
                       utf8(F.col(f"`{text_col}`")).alias("data"))
    lines = stage(rows.select(*_DOC, F.explode(
        line_keys(F.col("data"), min_words, near_words)).alias("l")).select(*_DOC, "l.*"), "lines")
    place = F.struct(*_PLACE)
    firsts = stage(lines.groupBy("line").agg(
        F.min(F.struct(*_PLACE, "halves")).alias("first"), F.count("*").alias("n")).select(
            "line", "first.*", "n"), "firsts")
    near = near_copies(rows, firsts.filter(F.size("halves") > 0)).withColumn("near", F.lit(True))
    doubtful = firsts.select("line", *_PLACE, "n").join(near, _PLACE, "left").filter(
        "n > 1 or near").select(
        "line", place.alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select(*_PLACE, "line").join(doubtful, "line").filter(
        F.col("near") | (place != F.col("first")))
    return gone.groupBy(*_DOC).agg(F.array_sort(F.collect_set("no")).alias("removed"))


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))


def _key(id_col: str, text_col: str) -> Column:
    """Digest of the text, after a byte that sets rows without an id behind the largest id."""
    missing = F.col(f"`{id_col}`").cast("long").isNull()
    return F.unhex(F.concat(F.when(missing, "01").otherwise("00"), F.md5(
        utf8(F.col(f"`{text_col}`")))))


def without_lines(text: Column, removed: Column) -> Column:
    """Text without the numbered lines; the text itself where none is to go."""
    kept = F.filter(F.split(text, "\n"), lambda _, at: ~F.array_contains(removed, at))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """Rows of `docs` without their later lines, and the numbers of those as `removed_lines`."""
    gone = stage(removed_lines(docs, id_col, text_col, min_words, near_words), "removed")
    rows = packed(docs, doc=_doc(id_col), key=_key(id_col, text_col), text=F.col(f"`{text_col}`"))
    joined = rows.join(gone, _DOC, "left")
    return unpacked(joined, **{
        text_col: without_lines(F.col("text"), F.col("removed")),
        "removed_lines": F.coalesce("removed", F.array().cast("array<int>"))})
