"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bpe
from runlens.llm import classifier
from runlens.llm import compression_rules
from runlens.llm import conversation_repair
from runlens.llm import hard_negatives
from runlens.llm import language_id
from runlens.llm import line_dedup
from runlens.llm import packing
from runlens.llm import sharding
from runlens.llm import simhash
from runlens.llm import suffix_dedup
from runlens.llm import topk
from runlens.llm import url_filter
from runlens.llm.common import utf8
from runlens.session import stage

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
KEPT_FROM = 0.7
SHARDS = 24
TOP = 5
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow",
         "net/es/": "block", "net/fr/": "block"}
#: The method's own list: known advertising hosts.
BLOCKED = ("ads-track.example.com/", "ads-track.example.net/", "ads-track.example.org/")


def query(work):
    REGISTRY[work.__name__] = work
    return work


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query
def op2_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cuts = suffix_dedup.repeats(docs).select(
        "key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    whole = docs.select("doc_id", suffix_dedup.text_key(F.col("text")).alias("key"),
                        F.octet_length(utf8("text")).cast("long").alias("n_bytes"),
                        F.sha2(utf8("text"), 256).alias("whole"))
    n_removed = F.coalesce("n_removed", F.lit(0))
    return whole.join(cuts, "key", "left").select(
        "doc_id", "n_bytes", n_removed.alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "whole").alias("kept_sha256"), (n_removed > 0).alias("changed"))


@query
def op3_compression_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", compression_rules.judged("text").alias("v")).select(
        "doc_id", "v.*")


@query
def op4_classifier(spark, sf_dir):
    rows = stage(table(spark, sf_dir, "documents").select(
        "doc_id", classifier.document_statistics("text").alias("statistics")), "statistics")
    model = classifier.fit(stage(classifier.labelled(
        rows, table(spark, sf_dir, "labels")), "labelled"))
    score = model.score(F.col("statistics"))
    return rows.select("doc_id", classifier.is_held_out(F.col("doc_id")).alias("held_out"),
                       score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= KEPT_FROM, 1).otherwise(0))


@query
def op5_hilbert_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(utf8("text")) + 8).cast("long").alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"))
    cells = [sharding.named_cell("lang"), sharding.named_cell("source"),
             sharding.scaled_cell("n_chars")]
    placed = sharding.shard(docs, cells, SHARDS, ties=[F.col("text_crc32"), F.col("size"),
                                                       F.col("doc_id")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op6_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, TOP, 256.0)


@query
def op7_byte_bpe(spark, sf_dir):
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(
        F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"),
                       F.sha2(utf8("text"), 256).alias("kept_sha256"))


@query
def op9_url_filter(spark, sf_dir):
    host, path = url_filter.host_and_path("url")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host.alias("host"), path.alias("path"))
    own = url_filter.publish(spark, RULES.items())
    listed = url_filter.publish(spark, [(host, "block") for host in BLOCKED])
    judged = pages.select("page_id", "host", "path", url_filter.judged("host", "path", own).alias(
        "own"), url_filter.judged("host", "path", listed).alias("listed"))
    return judged.select("page_id", "host", "path", "own.rule", F.coalesce(
        "own.verdict", "listed.verdict", F.lit("allow")).alias("verdict"))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORDS, keep_ids=False)


@query
def op11_hard_negatives(spark, sf_dir):
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(
        table(spark, sf_dir, "embeddings"), key % 100 == 0, label, 256.0)


@query
def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"),
                        "lang_pred", "score", "n_words", F.size("spans").alias("n_spans"))


@query
def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(turns))
