"""Training records: labels, weights, oversampling, and the projections that are stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.functions.payload import fight_weight, outcome
from runlens.operators.snapshots import fights_with_features
from runlens.schemas import LAKE, NUMERIC_FEATURES, TRAINING

ENRICHED = ("run_id", "boss_archetype", *TRAINING.fieldNames(), "weight", "event_type",
            "encounterId")


def enrich(fights: DataFrame, features: DataFrame) -> DataFrame:
    """Fights joined with the cached features of their run; fights without features drop out.

    The join stays a hint-free equi-join: features hold one row per run, and adaptive execution
    picks a broadcast by measured size and splits the fights of a large run.
    """
    taken = features.drop("boss_archetype", "event_type", "outcome", "weight", "timestamp",
                          "event_id", "encounter_id")
    return fights.drop("encounter_id").join(taken, "run_id")


def with_outcome(fights: DataFrame) -> DataFrame:
    return fights.withColumn("outcome", outcome(F.col("win")))


def with_weight(fights: DataFrame) -> DataFrame:
    return fights.withColumn("weight", fight_weight(F.col("event_type")))


def enriched_view(joined: DataFrame, *extra: str) -> DataFrame:
    """Labelled, weighted records; `encounterId` stays, as the lake needs it."""
    return with_weight(with_outcome(joined)).select(*extra, *ENRICHED)


def training_records(events: DataFrame) -> DataFrame:
    """Enriched records of all fights, each with the newest snapshot of its run before it."""
    return enriched_view(fights_with_features(events), "event_id")


def to_training(records: DataFrame) -> DataFrame:
    return records.select(*TRAINING.fieldNames())


def to_lake(records: DataFrame) -> DataFrame:
    return records.select(*LAKE.fieldNames())


def split_weight(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(light, full) records; a record without a weight is in neither."""
    return (records.filter(F.col("weight") < C.BOSS_WEIGHT),
            records.filter(F.col("weight") >= C.BOSS_WEIGHT))


def split_type(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elite, boss) records."""
    boss = F.col("event_type") == C.BOSS_DONE
    return records.filter(~boss), records.filter(boss)


def oversample(records: DataFrame, repeated: Column, n: int = C.OVERSAMPLE) -> DataFrame:
    """Repeat matching records n times in one scan; a record where the test is null drops out."""
    copies = F.when(repeated, n).when(~repeated, 1).otherwise(0)
    return records.filter(repeated.isNotNull()).withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(0), copies))).drop("_copy")


def oversampled_fights(records: DataFrame, n: int = C.OVERSAMPLE) -> DataFrame:
    return oversample(records, F.col("event_type") == C.BOSS_DONE, n)


def oversampled_history(records: DataFrame, n: int = C.OVERSAMPLE) -> DataFrame:
    return oversample(records, F.col("weight") >= C.BOSS_WEIGHT, n)


def batch_metrics(records: DataFrame) -> DataFrame:
    """Record counts per archetype and type: one partial aggregate for all audit figures."""
    boss = F.col("event_type") == C.BOSS_DONE
    return records.groupBy("boss_archetype").agg(
        F.count("*").alias("enriched"), F.count_if(boss).alias("persisted"),
        (F.count_if(~boss) + F.count_if(boss) * C.OVERSAMPLE).alias("oversampled"))


def labelled(records: DataFrame) -> DataFrame:
    return records.filter(F.col("outcome").isNotNull())


def infer_features(records: DataFrame) -> list[str]:
    """Numeric columns that are neither keys nor labels."""
    return [field.name for field in records.schema.fields
            if isinstance(field.dataType, T.NumericType) and field.name not in C.NON_FEATURES]


def scaling(records: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Mean and sample deviation per column of each group, by partial aggregation."""
    return records.groupBy(by).agg(*[
        F.struct(F.avg(name).alias("mean"), F.stddev_samp(name).alias("sd")).alias(f"_{name}")
        for name in columns])


def standardise(records: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES,
                by: str = "boss_archetype") -> DataFrame:
    """Z-scores of `columns` within each group.

    A window over a few archetypes would put each into one task. The figures per group are joined
    by key; adaptive execution broadcasts them where their measured size is small.
    """
    figures = scaling(records, columns, by)
    scores = {name: F.coalesce(F.try_divide(
        F.col(name) - F.col(f"_{name}.mean"), F.col(f"_{name}.sd")), F.lit(0.0))
        for name in columns}
    return records.join(figures, by).withColumns(scores).drop(*[f"_{name}" for name in columns])


def latest(rows: DataFrame, key: str, *order_by: str) -> DataFrame:
    """The newest row of each key; each map task sends at most one row per key."""
    window = Window.partitionBy(key).orderBy(*[F.desc(name) for name in order_by])
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def lookup_features(keys: DataFrame, features: DataFrame) -> DataFrame:
    """Features of the named runs only; keys are joined, never collected."""
    return features.join(keys.select("run_id").distinct(), "run_id", "left_semi")
