"""Per-run features as aggregates: they need no order and no window over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.payload import usable_archetype
from runlens.functions.vectors import hp_ratio
from runlens.operators.runs import ORDER, newest
from runlens.sources.events import filter_type, guard_triggers, known_events


def _of(event_type: str, value: Column, default: Column) -> Column:
    return F.when(F.col("event_type") == event_type, value).otherwise(default)


def contributions() -> dict[str, Column]:
    """What one event adds to each running total of its run."""
    none = F.lit(0.0)
    damage = F.col("dmg_amount")
    return {
        "total_dashes": _of(C.DASH, F.lit(1), F.lit(0)).cast("long"),
        "total_damage_dealt": _of(C.DAMAGE_DEALT, damage, none),
        "total_damage_taken": _of(C.DAMAGE_TAKEN, damage, none),
        "damage_taken_from_elites": _of(
            C.DAMAGE_TAKEN, F.when(F.col("is_elite_source"), damage).otherwise(none), none),
    }


def _summed(events: DataFrame, *names: str) -> DataFrame:
    added = contributions()
    return events.groupBy("run_id").agg(*[F.sum(added[name]).alias(name) for name in names])


def dash_count(events: DataFrame) -> DataFrame:
    return _summed(events, "total_dashes")


def damage_sums(events: DataFrame) -> DataFrame:
    return _summed(events, "total_damage_dealt", "total_damage_taken")


def elite_damage(events: DataFrame) -> DataFrame:
    return _summed(events, "damage_taken_from_elites")


def hp_readings(events: DataFrame) -> DataFrame:
    """Status events with a positive maximum, as ratios."""
    ratio = hp_ratio(F.col("hp"), F.col("max_hp"))
    return filter_type(events, C.STATUS).select("run_id", *ORDER, ratio.alias("hp_ratio")).filter(
        F.col("hp_ratio").isNotNull())


def avg_hp(events: DataFrame, last_n: int = C.HP_HISTORY) -> DataFrame:
    """Mean ratio of the last readings of each run that has any."""
    recent = newest(hp_readings(events), ["run_id"], ORDER, last_n)
    return recent.groupBy("run_id").agg(F.avg("hp_ratio").alias("avg_hp_percent"))


def counts_map(entries: Column) -> Column:
    """Map of (id, count) structs in id order, so that equal maps print alike."""
    return F.map_from_entries(F.array_sort(entries))


def upgrade_counts(events: DataFrame) -> DataFrame:
    """Upgrade counts of each run that chose any; one map entry per different upgrade.

    A choice without an upgrade counts nowhere, in the stream neither.
    """
    chosen = filter_type(events, C.UPGRADE).filter(F.col("chosen_upgrade_id").isNotNull())
    counted = chosen.groupBy("run_id", "chosen_upgrade_id").agg(
        F.count("*").cast("int").alias("n"))
    return counted.groupBy("run_id").agg(counts_map(
        F.collect_list(F.struct("chosen_upgrade_id", "n"))).alias("upgrade_counts"))


def counts_for_player() -> Column:
    """Events whose player can be that of the run: the one rule for features, snapshots, messages.

    Every event with a player but a trigger without a usable archetype; the first in the order of
    (timestamp, event_id) decides. Boss fights are no profile events and do not count.
    """
    kind = F.col("event_type")
    return F.col("player_id").isNotNull() & kind.isin(*C.PROFILE_EVENTS) & (
        ~kind.isin(*C.TRIGGER_EVENTS) | usable_archetype(F.col("boss_archetype")))


def run_player(events: DataFrame) -> DataFrame:
    """First known player of each run, by `counts_for_player`.

    The first timestamp per (run, player) comes first: its buffer is a plain number, so the large
    step stays a hash aggregate. Only players that share a run's first moment need event ids.
    """
    named = events.filter(counts_for_player())
    firsts = named.groupBy("run_id", "player_id", "timestamp").agg(
        F.min("event_id").alias("event_id"))
    firsts = firsts.groupBy("run_id").agg(F.min_by(
        "player_id", F.struct(*ORDER)).alias("player_id"))
    return events.select("run_id").distinct().join(firsts, "run_id", "left")


def feature_vectors(events: DataFrame, last_n: int = C.HP_HISTORY) -> DataFrame:
    """Feature vector of each run after its last event.

    One pass sums everything by (run, upgrade); the small second step folds these rows into runs,
    totals and the upgrade map alike.
    """
    events = guard_triggers(known_events(events))
    added = contributions()
    upgrade = F.when(F.col("event_type") == C.UPGRADE, F.col("chosen_upgrade_id"))
    parts = events.withColumn("upgrade", upgrade).groupBy("run_id", "upgrade").agg(
        F.count("*").cast("int").alias("n"),
        *[F.sum(column).alias(name) for name, column in added.items()])
    entry = F.when(F.col("upgrade").isNotNull(), F.struct("upgrade", "n"))
    runs = parts.groupBy("run_id").agg(
        *[F.sum(name).alias(name) for name in added],
        counts_map(F.collect_list(entry)).alias("upgrade_counts"))
    return runs.join(run_player(events), "run_id", "left").join(
        avg_hp(events, last_n), "run_id", "left").select(
        "run_id", "player_id", *added,
        F.coalesce("avg_hp_percent", F.lit(1.0)).alias("avg_hp_percent"), "upgrade_counts")


def distinct_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys).distinct()
