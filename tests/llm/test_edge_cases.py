"""Nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm import (bpe, classifier, compression_rules, line_dedup, packing, sharding,
                         simhash, suffix_dedup, topk, url_filter)
from runlens.llm.queries import RANKS, WORDS
from runlens.llm.suffix_sort import deep_shallow_sort

LONG = " ".join(f"word{i}" for i in range(200))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, "
          "KEY int, rows int, score string")


def rows_of(*pairs):
    return [(i, text, None, "s", None, "x", 1, 2, "y") for i, text in pairs]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(
        (1, LONG), (1, LONG), (None, LONG), (2, None), (3, ""), (None, None), (4, " \n\t "),
        (5, "a" * 5000), (6, "x" + LONG + "\n\n" + LONG), (7, "é" * 600)), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 10
    assert {row.component_id for row in found if row.fp == 0} == {2}
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(row.doc_id for row in kept.collect()) == [
        i for i in sorted({row.component_id for row in found})]


def test_suffix_dedup(odd, empty):
    found = suffix_dedup.remove_repeats(odd).collect()
    texts = {row.doc_id: row.text for row in found}
    assert len(found) == 10 and texts[5] == texts[7] == texts[1] == "" and texts[2] is None
    assert texts[6].strip("x\n") == "" and suffix_dedup.remove_repeats(empty).count() == 0


def test_grams_with_many_contexts_give_the_same(spark):
    docs = spark.createDataFrame(rows_of(*[
        (i, f"{i:04d}" * 40 + LONG[:500 + i] + f"{i:04d}" * 50) for i in range(40)]), SCHEMA)

    def cuts(**how):
        return sorted((row.key, row.kept, row.n_spans) for row in suffix_dedup.repeats(
            docs, **how).collect())

    assert cuts() == cuts(sorted_=3) and len(cuts()) == 40


def test_deep_shallow_sort():
    texts = [b"", b"a", LONG.encode(), LONG.encode()[:90], LONG.encode()[:90] + b"b",
             LONG.encode()[:90] + b"a", b"a", b"b" * 50, b"b" * 40]
    assert [texts[i] for i in deep_shallow_sort(texts)] == sorted(texts)


def test_compression_rules(odd, empty):
    kept = {row[0]: row[1].kept for row in odd.select(
        "doc_id", compression_rules.judged("text")).collect()}
    assert not kept[2] and not kept[3] and not kept[5]
    assert empty.select(compression_rules.judged("text")).count() == 0


def test_classifier(spark, odd, empty):
    rows = odd.select("doc_id", classifier.document_statistics("text").alias("statistics"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.fit(classifier.labelled(rows, none))
    scores = [row[0] for row in rows.select(model.score(F.col("statistics"))).collect()]
    assert scores == [1.0] * 10
    some = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(1, None)], none.schema)
    model = classifier.fit(classifier.labelled(rows, some))
    assert all(0 <= row[0] <= 1 for row in rows.select(
        model.score(F.col("statistics"))).collect())
    assert list(classifier.pool_adjacent([1, 1, 2], [1, 0, 2])) == [0.5, 0.5, 1.0]


def test_shards(odd, empty):
    cells = [sharding.named_cell("lang"), sharding.scaled_cell("n_chars")]
    found = sharding.shard(odd, cells, 3).collect()
    assert sorted(row.shard for row in found) == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert sharding.shard(empty, cells, 3).count() == 0


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, score int"
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (2, [1.0, 0.5], 1),
            (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1),
            (6, [-1.0, 0.0], 1), (7, [2.0], 1), (50, [1.0], 1)]
    found = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, 3, 256.0)
    by_query = {}
    for row in found.orderBy("query_id", "rank").collect():
        by_query.setdefault(row.query_id, []).append(row.vec_id)
    assert by_query == {0: [1, 2, 2], 50: [7]}
    none = topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0, 3, 256.0)
    assert none.count() == 0


def test_byte_bpe(odd, empty):
    import tiktoken

    codec = bpe.codec(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=codec.ranks, special_tokens={})
    for text in ("z" * 3000, "ab" * 500, " " * 999, "Donaudampfschifffahrtsgesellschaft" * 9,
                 "\U0001f600" * 99, "é" * 500, "1234567890" * 99):
        assert list(bpe.encode_text(text, public_tokenizers.PATTERN, codec)) == (
            library.encode_ordinary(text))
    coded = odd.select("text", bpe.encoded("text", RANKS, public_tokenizers.PATTERN).alias("ids"))
    for row in coded.select("text", bpe.decoded("ids", RANKS).alias("back")).collect():
        assert bytes(row.back) == (row.text or "").encode()
    assert empty.select(bpe.encoded("text", RANKS, public_tokenizers.PATTERN)).count() == 0


def test_line_dedup(spark, odd, empty):
    assert line_dedup.dedup_lines(odd).count() == 10
    assert line_dedup.dedup_lines(empty).count() == 0
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame(rows_of(
        (1, line), (2, line.replace("two", "2")), (3, f"{line} ten"), (4, line.replace("one ", "")),
        (5, line.replace("two", "2").replace("nine", "9")), (None, line), (6, "a b\na b")), SCHEMA)
    kept = {row.doc_id: row.text for row in line_dedup.dedup_lines(docs).collect()}
    # Line 5 is two words from line 1 but one from line 2, which is earlier though it goes itself.
    assert kept == {1: line, 2: "", 3: "", 4: "", 5: "", None: "", 6: "a b\na b"}


def test_line_dedup_knows_documents_by_id_and_text(spark):
    def line(name, n=9):
        return " ".join(f"{name}{i}" for i in range(n))

    def near(text):
        return text.replace("2", "two")

    last = (1 << 63) - 1
    long, short = "\n".join(map(line, "abcd")), "\n".join(map(line, "efgh"))
    docs = spark.createDataFrame(rows_of(
        (1, f"{near(line('d'))}\n{line('m', 5)}"),
        # Rows without an id: line 3 of one has an earlier near copy, line 3 of the other has none.
        (None, long), (None, short), (None, long), (None, line("s")),
        # One id, other texts: equal lines at the same place, and near ones.
        (7, f"{line('p')}\n{line('q')}"), (7, line("p")), (7, f"{near(line('p'))}\n{line('r')}"),
        (None, f"{line('t')}\n{line('u')}"), (None, f"{line('t')}\n{line('v')}"),
        # The largest id is an id: its row comes before one without.
        (last, line("w")), (None, line("w"))), SCHEMA)
    found = line_dedup.dedup_lines(docs).collect()
    kept = sorted((row.doc_id or 0, row.text) for row in found)
    assert len(kept) == 12
    assert [text for i, text in kept if i == 1] == [f"{near(line('d'))}\n{line('m', 5)}"]
    without = "\n".join(map(line, "abc"))
    texts = [text for i, text in kept if not i]
    assert texts.count(without) == 2 and short in texts and line("s") in texts
    assert [text for i, text in kept if i == last] == [line("w")] and line("w") not in texts
    # Of copies in rows with one id or none, one stays, and every other line does.
    shared = "\n".join(text for i, text in kept if i == 7).split("\n")
    assert sum(text in (line("p"), near(line("p"))) for text in shared) == 1
    assert {line("q"), line("r")} <= {*shared}
    lines = "\n".join(texts).split("\n")
    assert [lines.count(line(name)) for name in "tuv"] == [1, 1, 1]


def test_url_filter(spark):
    rows = [(None,), ("",), ("no scheme",), ("http://A.Example.COM?x",), ("http://b.org/p/q#f",)]
    host, path = url_filter.host_and_path("url")
    pages = spark.createDataFrame(rows, "url string").select(host.alias("h"), path.alias("p"))
    name = url_filter.publish(spark, [("org/", "block"), ("b.org/p/", "allow")])
    found = [(row.h, row.p, *row[2]) for row in pages.select(
        "h", "p", url_filter.judged("h", "p", name)).collect()]
    assert found == [("", "", None, None)] * 3 + [
        ("a.example.com", "", None, None), ("b.org", "/p/q", "b.org/p/", "allow")]


def test_colliding_digests_never_decide(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(url_filter, "digests", lambda strings: np.array(
        [7 for _ in strings], np.uint64))
    file = tmp_path / "digests"
    file.write_bytes(url_filter.digest_file([("a.org/", "block"), ("b.org/", "allow")]))
    rules, verdicts = url_filter.DigestArray(str(file)).verdicts(
        [b"a.org", b"b.org", b"c.org"], [b"/", b"/x", b"/"])
    assert rules == ["a.org/", "b.org/", None] and verdicts == ["block", "allow", None]


def test_packing(odd, empty):
    found = packing.pack(odd, WORDS).collect()
    assert all(len(row.ids) == row.length for row in found)
    assert sum(row.doc_tokens == 1 for row in found) == 4
    assert packing.pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("text", [
    "J\u030c T\u0308 H\u0331llo Y\u030a", "Ab <|endoftext|> Zed", "It's 10:30, KELVIN \u212a.",
    "\u0130stanbul caf\u00c9 CAFE\u0301 \u037e x", "tab\tnew\x0bline\x1cfs nbsp\u00a0end"])
def test_ids_of_words_are_those_of_the_text(text):
    library = Tokenizer.from_file(WORDS)
    found = packing.Words(WORDS).encode(text.encode())
    assert found[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pipeline_takes_odd_and_empty_tables(spark, odd, empty):
    folder = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        out = docs
        for _, work in corpus_pipeline.STAGES[1:]:
            out = work(spark, out, folder)
        out.count()
    assert corpus_pipeline.good_documents(spark, empty, folder).count() == 0
    texts = [hashlib.sha256((row.text or "").encode()).digest() for row in
             corpus_pipeline.different_documents(spark, odd, folder).collect()]
    assert len(texts) == len(set(texts))
