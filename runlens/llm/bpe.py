"""Byte-level BPE as a tree reduction.

Encodings of byte strings form a monoid: the encoding of a concatenation follows from those of its
two halves. A piece is halved down to short leaves, and neighbours are joined by encoding a window
over the seam again. The window grows on a side until its outer token and the token beside it
encode to just these two. As a token sequence is the encoding of its bytes exactly when every pair
of neighbours is, the tokens outside are then proven to stay. Pieces of the split pattern never
merge with each other, so a text is the plain concatenation of its pieces.

Null and empty texts give no ids and no bytes. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import Remembered, lists, utf8

#: Pieces of at most so many bytes are merged directly: the leaves of the tree.
LEAF_BYTES = 8
#: Bytes of encoded pieces that a worker remembers.
REMEMBERED = 48 << 20
#: Bytes of leaves, and of seams, that it remembers: halves of different pieces are often the same.
REMEMBERED_PARTS = 24 << 20
#: Bytes of texts that are handed back at once.
BATCH_BYTES = 4 << 20
#: Longer texts are cut into pieces one by one, so that no list of all pieces is held.
STREAMED_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        #: Ids are handed on as machine words, two bytes each where the vocabulary allows.
        self.kind = np.dtype(np.uint16 if len(self.token) <= 1 << 16 else np.uint32)
        self.leaf = Remembered(self._merged, REMEMBERED_PARTS).__getitem__
        self.seams = Remembered(self._seam, REMEMBERED_PARTS).__getitem__
        self.short = Remembered(self._piece, REMEMBERED).__getitem__

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece as machine words."""
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = self.encode_bytes(data) if whole is None else (whole,)
        return np.array(ids, self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        return self.short(piece) if len(piece) <= 32 else self._piece(piece)

    # --- encoding ---

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece: encode both halves, then join them."""
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        return self._join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """Ids of a short string by merging the neighbours of lowest rank, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks, none = self.ranks, len(self.ranks)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
        return tuple([ranks[part] for part in parts])

    def _seam(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """Ids of the bytes of neighbouring tokens."""
        return self._merged(b"".join([self.token[t] for t in tokens]))

    def seam(self, *tokens: int) -> tuple[int, ...]:
        return self.seams(tokens) if len(tokens) <= 8 else self._seam(tokens)

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            seam = self.seam(*left[-i:], *right[:j])
            if i == j == 1 and seam == (left[-1], right[0]):
                return left + right  # the two tokens stay as they are, and so does all beyond
            fits_left = i == len(left) or self.seam(left[-i - 1], seam[0]) == (
                left[-i - 1], seam[0])
            fits_right = j == len(right) or self.seam(seam[-1], right[j]) == (seam[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + seam + right[j:]
            i = i if fits_left else min(2 * i, len(left))
            j = j if fits_right else min(2 * j, len(right))

    # --- decoding ---

    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of a token sequence: decode both halves, then concatenate."""
        if len(ids) <= 4096:
            return b"".join([self.token[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(read_ranks(path))


@lru_cache(2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def encode_text(text: str, pattern: str, encoder: Codec) -> np.ndarray:
    """Ids of a whole text."""
    cut = _pattern(pattern)
    pieces = cut.findall(text) if len(text) <= STREAMED_CHARS else (
        match.group() for match in cut.finditer(text))
    return np.frombuffer(b"".join(map(encoder.piece, pieces)), encoder.kind)


def _ids(found: list[np.ndarray]) -> pa.ListArray:
    """Lists of ids, one per text."""
    joined = np.concatenate(found) if found else np.empty(0)
    return lists(pa.array(joined.astype(np.int32)), map(len, found))


def encoded(text: Column | str, vocabulary: str, pattern: str) -> Column:
    """Token ids of whole texts, as array<int>.

    `vocabulary` is the path of a rank file that every worker can read, `pattern` the regular
    expression that splits texts before the merges.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = codec(vocabulary)
        for batch in batches:
            yield _ids([encode_text(data.as_py().decode("utf-8", "replace"), pattern, encoder)
                        for data in batch])

    return _udf(encode, "array<int>")(utf8(text))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Token ids of whole texts and the bytes they decode to, in one pass: id, ids, decoded.

    Texts are handed back in batches of a few megabytes, whatever came in at once.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for batch in batches:
            ids, texts, held, start = [], [], 0, 0
            for at, data in enumerate(batch.column(1), 1):
                data = data.as_py()
                ids.append(encode_text(data.decode("utf-8", "replace"), pattern, coder))
                texts.append(coder.decode(ids[-1].tolist()))
                held += len(data)
                if held >= BATCH_BYTES or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, at - start), _ids(ids),
                         pa.array(texts, pa.binary())], ["id", "ids", "decoded"])
                    ids, texts, held, start = [], [], 0, at

    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(F.col(f"`{text_col}`")).alias("data"))
    return rows.mapInArrow(code, f"id {key}, ids array<int>, decoded binary").withColumnRenamed(
        "id", id_col)


def decoded(ids: Column | str, vocabulary: str) -> Column:
    """Bytes of token id arrays; null is empty."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = codec(vocabulary)
        for batch in batches:
            ids = batch.flatten().to_numpy()
            ends = accumulate(pc.fill_null(pc.list_value_length(batch), 0).to_pylist())
            at, texts = 0, []
            for end in ends:
                texts.append(decoder.decode(ids[at:end].tolist()))
                at = end
            yield pa.array(texts, pa.binary())

    return _udf(decode, "binary")(ids)


def _udf(work: Callable, kind: str):
    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, kind)
