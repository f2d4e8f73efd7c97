"""Gameplay events derived from a generic `events` table (event_id, ts, user_id, event_type,
value, props), as flat events and as JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import constants as C

_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def _milliseconds(events: DataFrame) -> Column:
    ts = F.col("ts")
    zone = events.sparkSession.conf.get("spark.sql.session.timeZone")
    if dict(events.dtypes)["ts"] == "timestamp_ntz" and zone not in _UTC:
        # Zone-free times count as UTC, whatever the session's zone.
        ts = F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts)
    return F.unix_millis(ts.cast("timestamp"))


def _event_type() -> Column:
    kind, at = F.col("event_type"), F.col("event_id")
    view = F.when(at % 4 == 0, C.STATUS).when(at % 4 == 1, C.MOVEMENT).otherwise(C.KILL)
    signup = F.when(at % 3 == 0, C.ENCOUNTER).when(at % 3 == 1, C.BOSS_DONE).otherwise(
        C.ELITE_DONE)
    return (
        F.when(kind == "click", C.DASH).when(kind == "error", C.DAMAGE_TAKEN)
        .when(kind == "purchase", F.when(at % 2 == 0, C.DAMAGE_DEALT).otherwise(C.UPGRADE))
        .when(kind == "view", view).when(kind == "signup", signup)
    )


def _fields(events: DataFrame, runs: int | None) -> DataFrame:
    """Raw payload fields, null where the event does not carry them."""
    k = F.col("k")
    user = F.col("user_id") if runs is None else F.col("user_id") % runs
    return events.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int")).select(
        "event_id", _milliseconds(events).alias("timestamp"), _event_type().alias("event_type"),
        F.concat(F.lit("player_"), F.col("user_id").cast("string")).alias("player_id"),
        F.concat(F.lit("run_"), user.cast("string")).alias("run_id"),
        (k % 7 - 3).cast("double").alias("x"), (k % 5 - 2).cast("double").alias("y"),
        F.when(k % 5 != 0, F.col("value")).alias("dmg_amount"),
        (k % 3 == 0).alias("is_elite_source"),
        k.cast("double").alias("hp"),
        F.when(k % 10 == 0, 0.0).otherwise(100.0).alias("max_hp"),
        F.when(k % 6 != 0, F.concat(F.lit("upg_"), (k % 4).cast("string"))).alias(
            "chosen_upgrade_id"),
        F.when(k % 8 != 0, F.concat(F.lit("enc_"), F.col("event_id").cast("string"))).alias(
            "encounter_id"),
        F.when(k % 5 == 0, "Melee").when(k % 5 == 1, "ranged").when(k % 5 == 2, "FINAL")
        .when(k % 5 == 3, "none").alias("boss_archetype"),
        F.when(k % 9 != 0, k % 2 == 0).alias("win"), "k",
    )


def gameplay_events(spark: SparkSession, sf_dir: str, runs: int | None = None,
                    source: DataFrame | None = None) -> DataFrame:
    """Flat gameplay events of the whole `events` table, or of a stream `source` of it.

    `runs` folds the users into that many long runs. Column `k` is kept for derived replies.
    """
    if source is None:
        source = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = _fields(source, runs)
    vector = F.col("event_type").isin(C.MOVEMENT, C.DASH, C.KILL)
    return raw.select(
        "event_id", "timestamp", "event_type", "player_id", "run_id",
        F.when(vector, F.col("x")).alias("x"), F.when(vector, F.col("y")).alias("y"),
        F.coalesce("dmg_amount", F.lit(0.0)).alias("dmg_amount"), "is_elite_source", "hp",
        "max_hp", F.coalesce("chosen_upgrade_id", F.lit(C.DEFAULT_UPGRADE)).alias(
            "chosen_upgrade_id"),
        "encounter_id", F.lower("boss_archetype").alias("boss_archetype"), "win", "k",
    )


def gameplay_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as JSON records (event_id, value) with nested payloads."""
    raw = _fields(spark.read.parquet(f"{sf_dir}/events.parquet"), None)
    kind = F.col("event_type")

    def only(*types: str):
        return lambda column: F.when(kind.isin(*types), column)

    def vector(event_type: str, x: str, y: str) -> Column:
        return only(event_type)(F.struct(F.col("x").alias(x), F.col("y").alias(y)))

    fights = only(C.ENCOUNTER, C.ELITE_DONE, C.BOSS_DONE)
    payload = F.struct(
        vector(C.MOVEMENT, "dx", "dy").alias("dir"),
        vector(C.DASH, "dx", "dy").alias("direction"),
        vector(C.KILL, "vx", "vy").alias("velocity"),
        only(C.DAMAGE_DEALT, C.DAMAGE_TAKEN)(F.col("dmg_amount")).alias("dmg_amount"),
        only(C.DAMAGE_TAKEN)(F.col("is_elite_source")).alias("is_elite_source"),
        only(C.STATUS)(F.col("hp")).alias("hp"),
        only(C.STATUS)(F.col("max_hp")).alias("max_hp"),
        only(C.UPGRADE)(F.col("chosen_upgrade_id")).alias("chosen_upgrade_id"),
        fights(F.col("encounter_id")).alias("encounter_id"),
        fights(F.col("boss_archetype")).alias("boss_archetype"),
        only(C.ELITE_DONE, C.BOSS_DONE)(F.col("win")).alias("win"),
    )
    return raw.select("event_id", F.to_json(F.struct(
        "event_type", "timestamp", "player_id", "run_id", payload.alias("payload"),
    )).alias("value"))
