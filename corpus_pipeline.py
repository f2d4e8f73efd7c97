"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of tables) and works on all rows its predecessor kept; all
but the last return the columns of `docs`. A null text counts as empty, null ids and repeated rows
are handled as each operator states, and an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import classifier, line_dedup, packing, simhash, suffix_dedup
from runlens.llm.common import WORD, packed, unpacked
from runlens.session import scratch_dir, stage

KEPT_FROM = 0.7
#: Bytes of words that a worker remembers during a task: workers live on through all stages.
REMEMBERED = 32 << 20
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from `labels`, does not reject."""
    rows = docs.select("doc_id", classifier.document_statistics("text").alias("statistics"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit(stage(classifier.labelled(rows, labels), "labelled"))
    scored = packed(docs, score=model.score(classifier.document_statistics("text")))
    return unpacked(scored.filter(F.col("score") >= KEPT_FROM)).select(*docs.columns)


def _with_new_text(docs: DataFrame, changed: DataFrame, touched: str) -> DataFrame:
    """Rows with their new texts and lengths, without those that lost all of their words."""
    rows = changed.filter(~F.col(touched) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(touched), F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those without words left go."""
    changed = line_dedup.dedup_lines(docs)
    return _with_new_text(docs, changed.withColumn(
        "removed_lines", F.size("removed_lines") > 0), "removed_lines")


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs).select(*docs.columns)


def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages found anywhere else; those without words left go."""
    changed = suffix_dedup.remove_repeats(docs)
    return _with_new_text(docs, changed.withColumn("n_removed", F.col("n_removed") > 0),
                          "n_removed")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in training sequences."""
    return packing.pack(docs, TOKENIZER, remembered=REMEMBERED, lasting=False)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", new_lines),
    ("simhash near-dedup", different_documents),
    ("suffix-array dedup", new_passages),
    ("packing", sequences),
]

#: A kernel fit, 64-bit XXH64 fingerprints and tokens are beyond SQL; a test holds the rows against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, work) in enumerate(STAGES):
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
