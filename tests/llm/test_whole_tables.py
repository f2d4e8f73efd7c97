"""Each query against a brute-force version over a whole table."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from runlens.llm import line_dedup, sharding
from runlens.llm.queries import RANKS, REGISTRY, WORDS

FOLDER = os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts() -> dict[int, str]:
    rows = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {row["doc_id"]: row["text"] or "" for row in rows}


def answer(spark, name: str) -> list:
    return REGISTRY[name](spark, FOLDER).collect()


def simhash(text: str) -> int:
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def least_reachable(ids: list, linked) -> dict:
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def components(texts: dict) -> tuple[dict, dict]:
    """Fingerprint and smallest reachable id of each document."""
    prints = {i: simhash(text) for i, text in texts.items()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    pairs = []
    for at, value in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values[:at] ^ value) <= 2)
        pairs += [(ids[at], ids[j]) for j in near]
    return prints, least_reachable(ids, pairs)


def test_simhash(spark, texts):
    prints, wanted = components(texts)
    rows = answer(spark, "op1_simhash")
    assert {row.doc_id: row.fingerprint for row in rows} == {
        i: f"{x:016x}" for i, x in prints.items()}
    assert {row.doc_id: row.component_id for row in rows} == wanted
    assert len(rows) == len(texts) and any(k != v for k, v in wanted.items())


def without_repeats(texts: dict, length: int = 400) -> dict:
    """Kept bytes, number of removed bytes and number of their runs of each text."""
    seen, found = Counter(), {}
    data = {i: text.encode() for i, text in texts.items()}
    for text in data.values():
        seen.update(xxhash.xxh3_128_digest(text[p:p + length])
                    for p in range(len(text) - length + 1))
    for i, text in data.items():
        edge = np.zeros(len(text) + 1, int)
        for p in range(len(text) - length + 1):
            if seen[xxhash.xxh3_128_digest(text[p:p + length])] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        found[i] = np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs
    return found


def test_suffix_dedup(spark, texts):
    found = {row.doc_id: row for row in answer(spark, "op2_suffix_dedup")}
    assert len(found) == len(texts)
    for i, (kept, gone, runs) in without_repeats(texts).items():
        row = found[i]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (
            len(texts[i].encode()), gone, runs, hashlib.sha256(kept).hexdigest()), i


def test_compression_rules(spark, texts):
    for row in answer(spark, "op3_compression_rules"):
        text = texts[row.doc_id]
        words = [w.decode() for w in WORD.findall(text.encode())]
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
                   for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x.encode())]
        base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                len(lines) - len(set(lines)), len(covered))
        assert tuple(row)[1:6] == base
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        assert row.base_failed == failed and not (failed and row.kept)


def test_classifier(spark, texts):
    rows = answer(spark, "op4_classifier")
    labels = {row["doc_id"]: row["quality"] for row in pq.read_table(
        f"{FOLDER}/labels.parquet").to_pylist()}
    assert len(rows) == len(texts)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    held = [(row.score, labels[row.doc_id]) for row in rows
            if row.held_out and row.doc_id in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    if good and bad:
        wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
        assert wins / (len(good) * len(bad)) > 0.9


def test_hilbert_shards(spark, texts):
    rows = answer(spark, "op5_hilbert_shards")
    sizes = Counter(row.shard for row in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(24)) <= 1
    slots = defaultdict(list)
    for row in rows:
        slots[row.shard].append(row.slot)
        data = texts[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(data) + 8, zlib.crc32(data))
        assert (row.law, row.grown_shard) == ("rows", None)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = sorted(rows, key=lambda row: (row.shard, row.slot))
    assert [row.curve for row in order] == sorted(row.curve for row in rows)


def test_hilbert_curve_is_continuous():
    axes = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    cells = np.stack([axis.ravel() for axis in axes])
    index = sharding.hilbert_index(list(cells), 3)
    assert sorted(index) == list(range(512))
    steps = np.abs(np.diff(cells[:, np.argsort(index)], axis=1)).sum(axis=0)
    assert set(steps) == {1}


def test_top_k(spark):
    rows = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pylist()
    ids = np.array([row["vec_id"] for row in rows])
    units = np.floor(256 * np.array([row["embedding"] for row in rows], float)).astype(int)
    wanted = {}
    for at in np.flatnonzero(ids % 50 == 0):
        scores = units @ units[at]
        order = [j for j in np.lexsort((ids, -scores)) if j != at][:5]
        wanted.update({(ids[at], rank): (ids[j], scores[j]) for rank, j in enumerate(order, 1)})
    found = {(row.query_id, row.rank): (row.vec_id, row.score)
             for row in answer(spark, "op6_top_k")}
    assert found == wanted


def test_byte_bpe(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    for row in answer(spark, "op7_byte_bpe"):
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def without_lines(texts: dict) -> dict:
    """Kept lines of each text, taken line by line in order of ids."""
    earlier: list[list[bytes]] = []
    by_words, by_variant, found = {}, defaultdict(list), {}
    for i in sorted(texts):
        kept = []
        for line in texts[i].split("\n"):
            words = WORD.findall(line.encode())
            gone = False
            if len(words) >= line_dedup.MIN_WORDS:
                key = tuple(words)
                near = len(words) >= line_dedup.NEAR_WORDS
                gone = key in by_words
                keys = [key, *[(*key[:at], *key[at + 1:]) for at in range(len(key))]]
                if near and not gone:
                    others = {j for k in keys for j in by_variant[k]}
                    gone = any(line_dedup.within_one_word(words, earlier[j]) for j in others)
                if key not in by_words:
                    by_words[key] = True
                    if near:
                        for k in keys:
                            by_variant[k].append(len(earlier))
                        earlier.append(words)
            if not gone:
                kept.append(line)
        found[i] = kept
    return found


def test_line_dedup(spark, texts):
    found = {row.doc_id: row for row in answer(spark, "op8_line_dedup")}
    for i, kept in without_lines(texts).items():
        row = found[i]
        assert row.n_lines == len(texts[i].split("\n"))
        assert row.n_removed == row.n_lines - len(kept), i
        assert row.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_url_filter(spark):
    pages = pq.read_table(f"{FOLDER}/pages.parquet", columns=["page_id", "url"]).to_pylist()
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow",
             "net/es/": "block", "net/fr/": "block"}
    found = {row.page_id: row for row in answer(spark, "op9_url_filter")}
    assert len(found) == len(pages)
    for page in pages:
        host, path = re.match(r".*?://([^/?#]*)([^?#]*)", page["url"], re.S).groups()
        fits = [rule for rule in rules if ("." + host).endswith("." + rule.split("/")[0])
                and path.startswith("/" + rule.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        row = found[page["page_id"]]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        if rule:
            assert row.verdict == rules[rule]
        else:
            assert row.verdict == ("block" if ".ads-track.example." in "." + host else "allow")


def test_packing(spark, texts):
    library = Tokenizer.from_file(WORDS)
    rows = answer(spark, "op10_packing")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for row in sorted(pieces, key=lambda row: row.start):
            assert row.start == at and row.doc_tokens == len(ids)
            at += row.length
            assert row.ids_crc32 == zlib.crc32(ids[row.start:at].tobytes())
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for row in sorted(pieces, key=lambda row: row.offset):
            assert row.offset == at
            at += row.length
        assert at <= 4096
        padding += 4096 - at
    assert padding < 4096 * 2
