"""Streaming jobs: profile fan-out, enrichment of fights, offers, and the bootstrap of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runlens import constants as C
from runlens.models import offers as O
from runlens.models import outcome as M
from runlens.operators import training as R
from runlens.sinks import outbox, tables
from runlens.sinks.topics import to_messages, write_topic, write_topics
from runlens.sources.events import decode_events, filter_type
from runlens.sources.tables import read_lake
from runlens.schemas import (
    AUDIT, NUMERIC_FEATURES, SESSION_EVENT, TRIGGER_MESSAGE, WAITING_FIGHT,
)
from runlens.streaming import asof
from runlens.streaming import profile as P

_QUERY_ID = "sql.streaming.queryId"
#: Records of a micro-batch that one task writes.
RECORDS_PER_TASK = 50_000


def batch_name(df: DataFrame, batch_id: int) -> str:
    """Name of a micro-batch: the same when it is tried again, different for another query."""
    return f"{df.sparkSession.sparkContext.getLocalProperty(_QUERY_ID)}-{batch_id}"


def start_batches(stream: DataFrame, work: Callable[[DataFrame, str], None], checkpoint: str,
                  interval: str | None = None, **trigger) -> StreamingQuery:
    """Run `work(rows, batch name)` per micro-batch, resuming from `checkpoint`."""
    writer = stream.writeStream.foreachBatch(
        lambda rows, batch_id: work(rows, batch_name(rows, batch_id)))
    if interval:
        trigger = {"processingTime": interval}
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.option("checkpointLocation", checkpoint).start()


def start_profile(events: DataFrame, cache: str, checkpoint: str,
                  rules: P.Rules = P.Rules(idle_ms=C.IDLE_MS), event_time: bool = False,
                  delay: str = "10 seconds",
                  topic_format: str = "kafka", topic_options: dict[str, str] | None = None,
                  **trigger) -> StreamingQuery:
    """Profile all runs; store snapshots, then send triggers, forms and predictions.

    Snapshots are seen no later than the triggers that refer to them. Messages in folders are
    committed together per batch (`sinks.outbox`); a Kafka topic has no such commit, and gets the
    messages of all topics by one write.
    """
    options = topic_options or {}

    def work(output: DataFrame, batch: str) -> None:
        output.persist()
        messages = {
            C.TRIGGERS_TOPIC: to_messages(P.triggers_of(output), C.TRIGGERS_TOPIC),
            C.PARAMS_TOPIC: to_messages(P.forms_of(output), C.FORM_MESSAGE),
            C.PREDICTIONS_TOPIC: to_messages(P.predictions_of(output), C.PREDICTION_MESSAGE),
        }

        def store() -> None:
            tables.upsert_latest(P.snapshots_of(output), cache, batch)

        try:
            if topic_format == "kafka":
                store()
                write_topics(messages, **options)
            else:
                settings = {**options}
                outbox.commit(settings.pop("path"), batch, messages, topic_format, store,
                              **settings)
        finally:
            output.unpersist()

    output = P.profile_stream(events, rules, event_time, delay)
    return start_batches(output, work, checkpoint, **trigger)


def waiting_fights(spark: SparkSession, unmatched: str, batch: str) -> DataFrame:
    """Fights that the micro-batch before `batch` left without features."""
    query, number = batch.rsplit("-", 1)
    if int(number) == 0:
        return spark.createDataFrame([], WAITING_FIGHT)
    return read_lake(spark, f"{unmatched}/waiting/{query}/{(int(number) - 1) % 2}", WAITING_FIGHT)


def keep_unmatched(fights: DataFrame, unmatched: str, batch: str, max_tries: int) -> None:
    """Store fights without features for the next micro-batch, after `max_tries` for good.

    Two folders take turns, so a batch that is tried again still finds what it read, and replaces
    what it wrote.
    """
    query, number = batch.rsplit("-", 1)
    fights.filter(F.col("tries") < max_tries).write.mode("overwrite").json(
        f"{unmatched}/waiting/{query}/{int(number) % 2}")
    fights.filter(F.col("tries") >= max_tries).write.mode("overwrite").json(
        f"{unmatched}/given_up/batch={batch}")


def start_enrichment(fights: DataFrame, cache: str, lake: str, training: str, checkpoint: str,
                     dry_run: bool = False, unmatched: str | None = None, max_tries: int = 10,
                     **trigger) -> StreamingQuery:
    """Join fights with cached features; append training rows and, for bosses, lake records.

    A fight gets the newest features cached at the time of the try, as there is nothing else in the
    cache; `start_asof_enrichment` gives each the features of its own time and drops none.

    The enriched frame is kept for the two writes. Both are named by the batch, so a batch that is
    tried again replaces its own output. With a folder `unmatched`, fights whose run has no cached
    features yet are tried again in the next micro-batches, and after `max_tries` are kept there
    under `given_up`; without it they are left out.
    """

    def work(outcomes: DataFrame, batch: str) -> None:
        spark = outcomes.sparkSession
        if unmatched:
            outcomes = outcomes.withColumn("tries", F.lit(0)).unionByName(
                waiting_fights(spark, unmatched, batch))
        outcomes.persist()
        features = tables.read_features(spark, cache, outcomes).persist()
        records = R.enriched_view(R.enrich(outcomes.drop("tries"), features)).persist()
        try:
            if dry_run:
                records.show(truncate=False)
                return
            tables.append_training(R.oversampled_fights(records), training, batch)
            bosses = R.split_type(records)[1]
            if not bosses.isEmpty():
                tables.append_lake(bosses, lake, batch)
            if unmatched:
                left = outcomes.join(features, "run_id", "left_anti")
                keep_unmatched(left.withColumn("tries", F.col("tries") + 1).select(
                    *WAITING_FIGHT.fieldNames()), unmatched, batch, max_tries)
        finally:
            for frame in (records, features, outcomes):
                frame.unpersist()

    return start_batches(fights, work, checkpoint, **trigger)


def start_asof_enrichment(fights: DataFrame, snapshots: DataFrame, lake: str, training: str,
                          side: str, checkpoint: str, delay: str = "10 seconds",
                          idle_ms: int | None = C.IDLE_MS, dry_run: bool = False,
                          parts: int | None = None, **trigger) -> StreamingQuery:
    """Join the fights with the snapshots of their time; append training rows and lake records.

    Nothing is dropped: fights that no snapshot came before are kept under `side/expired`. What was
    loaded, enriched, expired, oversampled and persisted is counted by the writes themselves, with
    no pass of its own, and kept under `side/audit`. All is named by the batch, so a batch that is
    tried again replaces its own output. A batch without matches writes no tables, and others write
    as many files as their rows need rather than one per partition of the state. `parts` is that of
    `asof.asof_stream`.
    """

    def work(found: DataFrame, batch: str) -> None:
        spark = found.sparkSession
        found = found.persist()
        try:
            records = R.enriched_view(asof.matched(found))
            if dry_run:
                records.show(truncate=False)
                return
            loaded, appended, stored = (Observation(name) for name in (
                "loaded", "appended", "stored"))
            left = found.observe(loaded, F.count("*").alias("loaded"), F.count_if(
                F.col("status") == asof.MATCHED).alias("enriched"), F.count_if(
                F.col("status") == asof.EXPIRED).alias("expired"))
            asof.expired(left).write.mode("overwrite").json(f"{side}/expired/batch={batch}")
            counts = {"oversampled": 0, "persisted": 0, **loaded.get}
            if counts["enriched"]:
                records = records.coalesce(-(-counts["enriched"] // RECORDS_PER_TASK))
                tables.append_training(R.oversampled_fights(records).observe(
                    appended, F.count("*").alias("oversampled")), training, batch)
                tables.append_lake(R.split_type(records)[1].observe(
                    stored, F.count("*").alias("persisted")), lake, batch)
                counts |= {**appended.get, **stored.get}
            spark.createDataFrame([tuple(counts[name] for name in AUDIT.fieldNames())], AUDIT
                                  ).coalesce(1).write.mode("overwrite").json(
                                      f"{side}/audit/batch={batch}")
        finally:
            found.unpersist()

    return start_batches(asof.asof_stream(fights, snapshots, delay, idle_ms, parts), work,
                         checkpoint, **trigger)


def audit_counts(spark: SparkSession, side: str) -> DataFrame:
    """What each batch of an enrichment job loaded and wrote."""
    return read_lake(spark, f"{side}/audit", T.StructType([
        *AUDIT.fields, T.StructField("batch", T.StringType())]))


def run_training(spark: SparkSession, training: str, weights: str) -> DataFrame:
    """Train on the stored tables and replace the weights that `start_offers` reads.

    Weights are a folder per archetype: one without training rows keeps its former model.
    """
    tables.ensure_tables(spark, training)
    learned = M.train(tables.read_training(spark, training), features=NUMERIC_FEATURES)
    learned.coalesce(1).write.option("partitionOverwriteMode", "dynamic").partitionBy(
        "boss_archetype").mode("overwrite").parquet(weights)
    return learned


def start_offers(records: DataFrame, cache: str, weights: str, checkpoint: str,
                 topic_format: str = "kafka", topic_options: dict[str, str] | None = None,
                 **trigger) -> StreamingQuery:
    """Answer encounter triggers with offers on the results topic.

    A trigger may carry the generated `reply`; without one, or without a model for its archetype,
    it gets the fallback. Triggers whose run has no cached features are dropped.
    """
    options = topic_options or {}
    triggers = decode_events(records, TRIGGER_MESSAGE).withColumn(
        "boss_archetype", F.lower(F.coalesce("boss_archetype", F.lit(C.DEFAULT_ARCHETYPE))))

    def work(asked: DataFrame, batch: str) -> None:
        spark = asked.sparkSession
        features = tables.read_features(spark, cache, asked)
        models = spark.read.schema(M.WEIGHTS).parquet(weights)
        offered = O.offers(M.score(O.triggers_with_features(asked, features), models))
        sink = {**options, **({} if topic_format == "kafka" else {"batch": batch})}
        write_topic(to_messages(offered, C.RESULT_MESSAGE), C.RESULTS_TOPIC, topic_format, **sink)

    return start_batches(triggers, work, checkpoint, **trigger)


def run_bootstrap(spark: SparkSession, lake: str, training: str, dry_run: bool = False) -> DataFrame:
    """Seed the lake once, then rebuild the training tables from all its records."""
    if not dry_run:
        tables.seed_if_absent(spark, lake)
    history = R.oversampled_history(read_lake(spark, lake))
    return tables.overwrite_training(history, training, dry_run=dry_run)


def session_starts(records: DataFrame) -> DataFrame:
    return filter_type(decode_events(records, SESSION_EVENT), C.SESSION_START)


def start_bootstrap(records: DataFrame, lake: str, training: str, markers: str, checkpoint: str,
                    interval: str = "10 seconds", **trigger) -> StreamingQuery:
    """Bootstrap on the first session start that this application sees.

    The marker is written after the work: a failure in between only repeats a rebuild, which gives
    the same tables.
    """

    def work(starts: DataFrame, batch: str) -> None:
        spark = starts.sparkSession
        marker = f"{markers}/application={spark.sparkContext.applicationId}"
        done = not read_lake(spark, marker, SESSION_EVENT).isEmpty()
        if done or starts.isEmpty():
            return
        run_bootstrap(spark, lake, training)
        spark.createDataFrame([(C.SESSION_START,)], SESSION_EVENT).write.mode("overwrite").json(
            marker)

    return start_batches(session_starts(records), work, checkpoint,
                         None if trigger else interval, **trigger)
