"""First-fit decreasing packing of token sequences, with a tournament tree of bin capacities.

Documents are tokenized, cut at multiples of the sequence length, and their pieces packed into
sequences. First fit decreasing needs all pieces of a bin set in one place, so pieces are dealt
into randomised groups of bounded size, each packed on its own: a group is one task's work, and
its one unfilled bin is lost among thousands of full ones. The random number of a document is drawn
once and written with its token count, so a task that is tried again packs the same pieces.

A null or empty text is a document of the end id alone. Repeated rows are packed like any others;
rows without an id keep their null id. An empty table gives no pieces.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from struct import pack as pack_words

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import Remembered, lists, utf8
from runlens.session import stage

SEQUENCE = 4096
END_ID = 2
#: Pieces of a group on average: packed by one task, some 65 MB at most with all ids.
GROUP_PIECES = 4_000
#: Bytes of words with their ids that a worker remembers.
REMEMBERED = 120 << 20
#: Bytes of texts that are handed back at once.
BATCH_BYTES = 4 << 20
_SEED = 20
_PUNCTUATION = frozenset((b".", b",", b";", b":", b"!", b"?"))

#: Latin letters beyond ASCII that may be plain.
_LATIN = range(0xC0, 0x250)


def _printed() -> dict[int, int]:
    """Characters that byte-level vocabularies print bytes as: themselves, or past U+0100 in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: 256 + at for at, byte in enumerate(hidden)}


_PRINTED = _printed()


class Words:
    """Ids of words between ASCII white space, as the tokenizer gives them.

    The tokenizer lower-cases, drops white space, and never merges across it, so a text has the ids
    of its words in turn, and words recur. A run of letters goes to the tokenizer's merges as it is;
    before one mark of punctuation it is a word of its own. Letters beyond ASCII are those Latin
    ones of which the tokenizer itself shows, when it is loaded, that their bytes are all it sees.
    Ids are kept as machine words, two bytes each where the vocabulary allows.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if small else "<u4")
        self.code = "<%dH" if small else "<%dI"
        self.ids = Remembered(self._ids, remembered)
        letters = "".join(filter(self._is_plain, map(chr, _LATIN)))
        self.plain = re.compile(f"[a-zA-Z{letters}]+").fullmatch

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, letters: str) -> list[int]:
        """Ids of a run of letters: the merges know bytes as printed characters."""
        data = letters.lower().encode().decode("latin-1").translate(_PRINTED)
        return [token.id for token in self.model.tokenize(data)]

    def _is_plain(self, letter: str) -> bool:
        return letter.isalpha() and all(
            self._whole(text) == self._merged(text)
            for text in (letter, f"a{letter}", f"{letter}{letter}b"))

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = [token.id for token in self.model.tokenize(word.lower().decode())]
        elif word[-1:] in _PUNCTUATION and self.plain(word[:-1].decode("utf-8", "replace")):
            return self.ids[word[:-1]] + self.ids[word[-1:]]
        else:
            text = word.decode("utf-8", "replace")
            ids = self._merged(text) if self.plain(text) else self._whole(text)
        return pack_words(self.code % len(ids), *ids)

    def encode(self, data: bytes) -> np.ndarray:
        # Special tokens are matched, and combining marks (0xCC leads their bytes) put together
        # with their letters, before letters are lower-cased.
        if b"<|" not in data and b"\xcc" not in data:
            data = data.lower()
        ids = np.frombuffer(b"".join(map(self.ids.__getitem__, data.split())), self.kind)
        return np.append(ids.astype(np.uint32), np.uint32(END_ID))


@lru_cache(1)
def _words(path: str, remembered: int) -> Words:
    return Words(path, remembered)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str,
              keep_ids: bool, remembered: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """Of whole texts, their id, a random number, token count, CRC-32 of each piece, and ids.

    Texts are handed back in batches of a few megabytes, whatever came in at once.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer, remembered) if lasting else Words(tokenizer, remembered)
        yield from encoded(batches, words)
        if not lasting:
            # The words know each other in a circle, which only a collection frees.
            del words
            gc.collect()
            pa.default_memory_pool().release_unused()

    def encoded(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, crcs, ids, held, start = [], [], [], 0, 0
            for at, data in enumerate(batch.column(2), 1):
                data = data.as_py()
                found = words.encode(data)
                counts.append(len(found))
                crcs.append([zlib.crc32(found[i:i + SEQUENCE].astype("<u4"))
                             for i in range(0, len(found), SEQUENCE)])
                if keep_ids:
                    ids.append(found.astype(np.int32))
                held += len(data)
                if held >= BATCH_BYTES or at == batch.num_rows:
                    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, at - start),
                         batch.column(1).slice(start, at - start), pa.array(counts, pa.int64()),
                         pa.array(crcs, pa.list_(pa.int64())),
                         lists(pa.array(values), map(len, ids) if keep_ids else [0] * len(counts))],
                        ["doc_id", "draw", "n", "crc", "ids"])
                    counts, crcs, ids, held, start = [], [], [], 0, at

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.rand(_SEED).alias("draw"),
        utf8(F.col(f"`{text_col}`")).alias("data")).mapInArrow(
            tokens, f"doc_id {kind}, draw double, n long, crc array<long>, ids array<int>")


class Bins:
    """Bins of equal capacity in order of opening; a tournament tree holds the most room below."""

    def __init__(self, items: int, capacity: int) -> None:
        self.leaves = 1 << max(0, items - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Number of the first bin with room for `size`, which is taken there."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found, room[at] = at - self.leaves, room[at] - size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; equal sizes are taken in the order given."""
    bins, filled = Bins(len(sizes), capacity), {}
    number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for at in np.argsort(-sizes, kind="stable"):
        size = int(sizes[at])
        found = bins.place(size)
        number[at], offset[at] = found, filled.get(found, 0)
        filled[found] = filled.get(found, 0) + size
    return number, offset


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = True, group_pieces: int = GROUP_PIECES,
         remembered: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most `SEQUENCE` tokens.

    Columns: the id, start, length, ids (with `keep_ids`), ids_crc32, doc_tokens, sequence_id and
    offset. Other columns of `docs` take no part. Workers remember words of `remembered` bytes for
    as long as they live, which costs later stages of the same job that memory; those that are not
    `lasting` forget them, and the tokenizer, with each task.
    """
    tokens = stage(tokenised(docs, tokenizer, id_col, text_col, keep_ids,
                              remembered, lasting), "tokens")
    n = tokens.agg(F.sum(F.size("crc"))).first()[0] or 0
    groups = max(1, ceil(n / group_pieces))
    pieces = tokens.select(
        "doc_id", "draw", F.col("n").alias("doc_tokens"), F.posexplode("crc").alias(
            "at", "ids_crc32"), *(["ids"] if keep_ids else []))
    start = F.col("at").cast("long") * SEQUENCE
    # A document's pieces spread over the groups too: one very long document fills none alone.
    part = F.floor(F.expr("pmod(draw + at * 0.6180339887498949D, 1.0D)") * groups)
    pieces = pieces.select(
        "doc_id", part.alias("part"), "doc_tokens", "ids_crc32", start.alias("start"),
        F.least(F.lit(SEQUENCE), F.col("doc_tokens") - start).alias("length"),
        *([F.slice("ids", start.cast("int") + 1, SEQUENCE).alias("ids")] if keep_ids else []))
    out = T.StructType([*pieces.drop("part").schema.fields,
                        T.StructField("sequence_id", T.LongType()),
                        T.StructField("offset", T.LongType())])

    def packed(rows: pa.Table) -> pa.Table:
        # Places are added beside the columns, which stay as they are: ids are never copied.
        length, crc, start = (rows[name].to_numpy() for name in ("length", "ids_crc32", "start"))
        order = np.lexsort((start, crc, length))
        number, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order], offset[order] = first_fit_decreasing(length[order], SEQUENCE)
        part = rows["part"][0].as_py()
        return rows.drop_columns(["part"]).append_column(
            "sequence_id", pa.array((part << 32) + number)).append_column(
            "offset", pa.array(offset))

    placed = pieces.groupBy("part").applyInArrow(packed, out)
    return placed.select(
        F.col("doc_id").alias(id_col), "start", "length", *(["ids"] if keep_ids else []),
        "ids_crc32", "doc_tokens", "sequence_id", "offset")
