"""Workers of the pipeline keep no words and no tokenizer once a task is over."""

import corpus_pipeline
from runlens.llm import packing


def test_pipeline_workers_forget_words(spark):
    def words_alive(rows):
        import gc

        list(rows)
        yield sum(type(found).__name__ == "Words" for found in gc.get_objects())

    docs = spark.range(200).selectExpr("id as doc_id", "concat('word', id, ' and others') as text")
    pieces = corpus_pipeline.sequences(spark, docs, "").collect()
    assert sorted(row.doc_id for row in pieces) == list(range(200))
    counts = spark.sparkContext.parallelize(range(64), 64).mapPartitions(words_alive).collect()
    assert len(counts) == 64 and max(counts) == 0


def test_same_pieces_whether_words_last(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 400) as text")
    made = [sorted(map(tuple, packing.pack(
        docs, corpus_pipeline.TOKENIZER, keep_ids=False, lasting=lasting).collect()))
        for lasting in (False, True)]
    assert made[0] == made[1]
