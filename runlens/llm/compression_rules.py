"""Quality rules on compression bands.

Repetitive text compresses too well, noise too badly. A text is compressed whole and in fixed
chunks of its bytes; the share of bytes that is left must lie within a band. As short inputs
compress badly whatever they say, each length class has limits of its own. Basic counts of words,
symbols, repeated lines and repeated word windows come from the same pass.

A null or empty text has no words: counts of zero, and the base rule rejects it. Repeated rows get
equal rows; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.llm.common import utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
SPACE = b" \t\n\v\f\r"
_TAILS = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Band:
    """Limits of what compression leaves, for inputs of at least `from_bytes` bytes."""

    from_bytes: int
    lowest: float
    highest: float


#: Below the first class no verdict is made: a few dozen bytes say nothing.
WHOLE = (Band(200, 0.40, 0.95), Band(500, 0.34, 0.85), Band(2_000, 0.30, 0.75),
         Band(10_000, 0.26, 0.70))
CHUNK_BYTES = 2048
#: A chunk shorter than the first class is judged as part of the whole only.
CHUNK = (Band(1024, 0.34, 0.85), Band(2048, 0.32, 0.80))
#: Share of chunks that may lie outside their band.
CHUNKS_OUTSIDE = 0.34
LEVEL = 3

VERDICT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,"
           "n_repeat_words:bigint,whole_ratio:double,chunks:bigint,chunks_low:bigint,"
           "chunks_high:bigint,base_failed:boolean,kept:boolean>")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more, the first included.

    Windows get their numbers by doubling: a pair of numbers of half windows is one number of the
    whole, so equal numbers are equal windows.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        distinct, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        size *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _band(bands: tuple[Band, ...], size: int) -> Band | None:
    return next((band for band in reversed(bands) if size >= band.from_bytes), None)


class Judge:
    """Counts and verdict of one text at a time."""

    def __init__(self, whole: tuple[Band, ...], chunk: tuple[Band, ...], chunk_bytes: int,
                 chunks_outside: float, level: int) -> None:
        self.whole, self.chunk, self.chunk_bytes = whole, chunk, chunk_bytes
        self.chunks_outside = chunks_outside
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def ratio(self, data: bytes | memoryview) -> float:
        return len(self.compress(data)) / len(data) if len(data) else 1.0

    def __call__(self, data: bytes) -> tuple:
        words = data.split()
        letters = data.translate(None, SPACE)
        lines = [line for line in data.split(b"\n") if line and not line.isspace()]
        repeated = repeat_words(words)
        base_failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        whole, chunks, low, high = self.ratio(data), 0, 0, 0
        view = memoryview(data)
        for at in range(0, len(data), self.chunk_bytes):
            part = view[at:at + self.chunk_bytes]
            band = _band(self.chunk, len(part))
            if band:
                left = self.ratio(part)
                chunks += 1
                low += left < band.lowest
                high += left > band.highest
        band = _band(self.whole, len(data))
        kept = not base_failed and (band is None or band.lowest <= whole <= band.highest) and (
            low + high <= self.chunks_outside * chunks)
        return (len(words), len(letters.translate(None, _TAILS)),
                len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
                repeated, whole, chunks, low, high, base_failed, kept)


def judged(text: Column | str, whole: tuple[Band, ...] = WHOLE, chunk: tuple[Band, ...] = CHUNK,
           chunk_bytes: int = CHUNK_BYTES, chunks_outside: float = CHUNKS_OUTSIDE,
           level: int = LEVEL) -> Column:
    """Struct `VERDICT` of whole texts."""

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = Judge(whole, chunk, chunk_bytes, chunks_outside, level)
        names = [field.partition(":")[0] for field in VERDICT[7:-1].split(",")]
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 3 + [pa.bool_()] * 2
        for batch in batches:
            found = [one(data.as_py()) for data in batch]
            columns = zip(*found) if found else [[]] * len(names)
            yield pa.StructArray.from_arrays(
                [pa.array(column, kind) for column, kind in zip(columns, kinds)], names)

    judge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judge, VERDICT)(utf8(text))
