"""Each stage of the pipeline against brute force, on the rows its predecessor kept."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from test_whole_tables import FOLDER, WORD, components, without_lines, without_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from runlens.llm.queries import REGISTRY


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows before and after each stage, written and read as `run` does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for number, (_, work) in enumerate(corpus_pipeline.STAGES):
        work(spark, docs, FOLDER).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        found.append(docs)
    return [[row.asDict() for row in table.collect()] for table in found]


def texts_of(rows) -> dict:
    return {row["doc_id"]: row["text"] or "" for row in rows}


def changed(rows, new: dict) -> dict:
    """Rows by id with new texts and lengths, without those that lost all of their words."""
    out = {}
    for row in rows:
        text = new[row["doc_id"]]
        if text == row["text"]:
            out[row["doc_id"]] = row
        elif WORD.search(text.encode()):
            out[row["doc_id"]] = {**row, "text": text, "n_chars": len(text)}
    return out


def by_id(rows) -> dict:
    found = {row["doc_id"]: row for row in rows}
    assert len(found) == len(rows)
    return found


def test_rejected_documents_go(spark, tables):
    scores = REGISTRY["op4_classifier"](spark, FOLDER).collect()
    good = {row.doc_id for row in scores if row.predicted == 1}
    assert 0 < len(good) < len(tables[0])
    assert by_id(tables[1]) == {i: row for i, row in by_id(tables[0]).items() if i in good}


def test_later_lines_go(tables):
    kept = {i: "\n".join(lines) for i, lines in without_lines(texts_of(tables[1])).items()}
    assert by_id(tables[2]) == changed(tables[1], kept)


def test_one_document_of_each_group_stays(tables):
    _, least = components(texts_of(tables[2]))
    assert by_id(tables[3]) == {i: row for i, row in by_id(tables[2]).items() if least[i] == i}


def test_repeated_passages_go(tables):
    kept = {i: data.decode("utf-8", "ignore")
            for i, (data, _, _) in without_repeats(texts_of(tables[3])).items()}
    assert by_id(tables[4]) == changed(tables[3], kept)


def test_kept_texts_are_packed(tables):
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in tables[5]:
        pieces[row["doc_id"]].append(row)
        sequences[row["sequence_id"]].append(row)
    texts = texts_of(tables[4])
    assert set(pieces) == set(texts)
    for i, rows in pieces.items():
        rows.sort(key=lambda row: row["start"])
        ids = library.encode(texts[i], add_special_tokens=False).ids + [2]
        assert np.concatenate([row["ids"] for row in rows]).tolist() == ids
        assert all(row["length"] == len(row["ids"]) for row in rows)
    for rows in sequences.values():
        rows.sort(key=lambda row: row["offset"])
        ends = np.cumsum([row["length"] for row in rows])
        assert [row["offset"] for row in rows] == [0, *ends[:-1]] and ends[-1] <= 4096
