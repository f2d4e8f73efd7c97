"""Point-in-time feature vectors, and their as-of lookup by fights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.payload import encounter_or_new
from runlens.functions.vectors import hp_ratio
from runlens.operators.features import contributions, counts_for_player, counts_map
from runlens.operators.runs import ORDER, RunFrame, by_run, large_keys, union_all
from runlens.sources.events import (
    delivered_once, filter_type, guard_triggers, known_events, with_archetype,
)

TOTALS = ("total_dashes", "total_damage_dealt", "total_damage_taken", "damage_taken_from_elites")
FIGHT_COLUMNS = ("run_id", *ORDER, "event_type", "boss_archetype", "win")


def is_trigger() -> Column:
    return F.col("event_type").isin(*C.TRIGGER_EVENTS)


def is_late() -> Column:
    """1 for boss fights: they come after all snapshots of the same time."""
    return F.when(F.col("event_type") == C.BOSS_DONE, 1).otherwise(0)


def _profile_rows(events: DataFrame, *extra: str) -> DataFrame:
    """Events as additions to the profile of their run."""
    ratio = F.when(F.col("event_type") == C.STATUS, hp_ratio(F.col("hp"), F.col("max_hp")))
    return events.select(
        "run_id", *ORDER, F.when(counts_for_player(), F.col("player_id")).alias("player_id"),
        "event_type", "boss_archetype", "encounter_id", *extra,
        *[column.alias(name) for name, column in contributions().items()],
        ratio.alias("hp_ratio"), ratio.isNotNull().alias("is_reading"))


def _with_profile(frame: RunFrame, last_n: int) -> RunFrame:
    """Running totals, first player and recent mean HP at each row.

    One shuffle by run serves all windows. The frame over readings comes first, so that every
    other window shares the second sort.
    """
    frame = frame.with_totals(sums=TOTALS, firsts=("player_id",)).with_tail(
        last_n, ["hp_ratio", "is_reading"], F.col("is_reading")).gathered()
    recent = F.avg("hp_ratio").over(frame.last_rows(last_n, "is_reading"))
    rows = frame.df.withColumn("_mean", F.when(F.col("is_reading"), recent))
    running = frame.running()
    kept = [name for name in frame.df.columns if name not in (*TOTALS, "player_id")]
    mean = F.last("_mean", ignorenulls=True).over(running)
    return frame.on(rows.select(
        *kept, *[F.sum(name).over(running).alias(name) for name in TOTALS],
        F.first("player_id", ignorenulls=True).over(running).alias("player_id"),
        F.coalesce(mean, F.lit(1.0)).alias("avg_hp_percent")))


def _encounter() -> Column:
    return encounter_or_new(F.col("encounter_id"), F.col("run_id"), F.col("timestamp"))


def snapshots(events: DataFrame, last_n: int = C.HP_HISTORY,
              upgrades: bool = True) -> DataFrame:
    """Feature vector of the run at each feature trigger with a usable archetype."""
    events = guard_triggers(known_events(events))

    def work(frame: RunFrame) -> DataFrame:
        return _with_profile(frame, last_n).own().filter(is_trigger()).select(
            "run_id", *ORDER, "player_id", "event_type", "boss_archetype", "encounter_id",
            _encounter().alias("encounterId"), *TOTALS, "avg_hp_percent")

    rows = _profile_rows(events)
    small = large_keys(rows) is None
    taken = by_run(rows, work, checked=small)
    return with_upgrades(taken, events, "event_id", small) if upgrades else taken


def running_upgrades(events: DataFrame, checked: bool = False) -> DataFrame:
    """Upgrade counts so far at each feature trigger: (run_id, event_id, upgrade_counts).

    Each trigger gets one mark per different upgrade of its run, which is one per map entry it may
    hold; marks and choices are then counted in order per (run, upgrade). The history of choices
    itself is never collected.
    """
    events = guard_triggers(events)
    choices = filter_type(events, C.UPGRADE).select(
        "run_id", *ORDER, "chosen_upgrade_id", F.lit(1).alias("n"))
    offered = choices.groupBy("run_id").agg(F.collect_set("chosen_upgrade_id").alias("ids"))
    # A trigger that was delivered twice is marked once.
    marks = delivered_once(filter_type(events, *C.TRIGGER_EVENTS).select("run_id", *ORDER)).join(
        offered, "run_id").select(
        "run_id", *ORDER, F.explode("ids").alias("chosen_upgrade_id"), F.lit(0).alias("n"))

    def work(frame: RunFrame) -> DataFrame:
        frame = frame.with_totals(sums=("n",))
        counted = F.sum("n").over(frame.running()).cast("int")
        rows = frame.on(frame.df.withColumn("so_far", counted)).own()
        return rows.filter("n = 0 and so_far > 0").select(
            "run_id", "event_id", "chosen_upgrade_id", "so_far")

    if not checked:
        # A run's triggers and choices bound the rows of each of its upgrades.
        checked = large_keys(filter_type(events, C.UPGRADE, *C.TRIGGER_EVENTS)) is None
    entries = by_run(union_all(choices, marks), work, by=("run_id", "chosen_upgrade_id"),
                     checked=checked)
    return entries.groupBy("run_id", "event_id").agg(counts_map(
        F.collect_list(F.struct("chosen_upgrade_id", "so_far"))).alias("upgrade_counts"))


def with_upgrades(rows: DataFrame, events: DataFrame, snapshot_id: str,
                  checked: bool = False) -> DataFrame:
    """Add the upgrade map of the snapshot named by column `snapshot_id`."""
    maps = running_upgrades(events, checked).withColumnRenamed("event_id", snapshot_id)
    empty = F.create_map().cast("map<string,int>")
    return rows.join(maps, ["run_id", snapshot_id], "left").withColumn(
        "upgrade_counts", F.coalesce("upgrade_counts", empty))


def fights(events: DataFrame) -> DataFrame:
    """Completed fights with a usable archetype."""
    return with_archetype(filter_type(events, *C.FIGHT_EVENTS)).select(*FIGHT_COLUMNS)


def asof_features(outcomes: DataFrame, taken: DataFrame, checked: bool = False) -> DataFrame:
    """Fights with the newest snapshot of their run taken at or before them.

    Both sides become one ordered stream per run, so no pair of rows is ever compared. At equal
    times an elite fight has its own snapshot, a boss fight that of the largest event id. Fights
    without an earlier snapshot are left out. `checked` says that the caller has found no large run
    in the rows that both sides come from, which spares computing the snapshots to count them.
    """
    fields = [name for name in taken.columns if name not in ("run_id", "timestamp")]
    shots = taken.select(
        "run_id", "timestamp", F.lit(0).alias("late"), F.lit(0).alias("is_fight"), "event_id",
        F.struct(*fields).alias("snapshot"))
    order_by = ("timestamp", "late", "event_id", "is_fight")
    fight_fields = [name for name in outcomes.columns if name not in ("run_id", *ORDER)]
    sought = outcomes.select("run_id", "timestamp", is_late().alias("late"),
                             F.lit(1).alias("is_fight"), "event_id", *fight_fields)

    clashes = {*fight_fields, "event_id"}

    def work(frame: RunFrame) -> DataFrame:
        frame = frame.with_totals(lasts=("snapshot",))
        newest = F.last("snapshot", ignorenulls=True).over(frame.running())
        found = frame.on(frame.df.withColumn("snapshot", newest)).own()
        return found.filter("is_fight = 1 and snapshot is not null").select(
            "run_id", *ORDER, *fight_fields, F.col("snapshot.event_id").alias("snapshot_id"),
            *[F.col(f"snapshot.{name}") for name in fields if name not in clashes])

    return by_run(sought.unionByName(shots, allowMissingColumns=True), work, order_by=order_by,
                  checked=checked)


def unmatched_fights(events: DataFrame) -> DataFrame:
    """Fights before the first snapshot of their run, which training leaves out.

    The first snapshot per run is a plain aggregate, so no order within the run is needed.
    """
    since = guard_triggers(filter_type(events, *C.TRIGGER_EVENTS)).groupBy("run_id").agg(
        F.min("timestamp").alias("since"))
    return fights(events).join(since, "run_id", "left").filter(
        F.col("since").isNull() | (F.col("timestamp") < F.col("since"))).drop("since")


def fights_with_features(events: DataFrame, last_n: int = C.HP_HISTORY,
                         upgrades: bool = True) -> DataFrame:
    """Snapshots and their as-of lookup in one ordered pass over the events.

    Same rows as `asof_features(fights(events), snapshots(events))`: a snapshot is a value of its
    trigger row, carried forward to the fights that follow it in the run.
    """
    events = guard_triggers(filter_type(events, *C.PROFILE_EVENTS, C.BOSS_DONE))
    snapshot = F.struct(
        F.col("event_id").alias("snapshot_id"), "player_id", _encounter().alias("encounterId"),
        *TOTALS, "avg_hp_percent")

    def work(frame: RunFrame) -> DataFrame:
        frame = _with_profile(frame, last_n)
        rows = frame.df.select(*frame.keys, *[name for name in ("lead_in",) if frame.split],
                               *frame.order_by, "event_type", "boss_archetype", "win",
                               F.when(is_trigger(), snapshot).alias("snapshot"))
        frame = frame.on(rows).settled().with_totals(lasts=("snapshot",))
        newest = F.last("snapshot", ignorenulls=True).over(frame.running())
        found = frame.on(frame.df.withColumn("snapshot", newest)).own()
        return with_archetype(filter_type(found, *C.FIGHT_EVENTS)).filter(
            "snapshot is not null").select(*FIGHT_COLUMNS, "snapshot.*")

    rows = _profile_rows(events, "win").withColumn("late", is_late())
    small = large_keys(rows) is None
    found = by_run(rows, work, order_by=("timestamp", "late", "event_id"), checked=small)
    return with_upgrades(found, events, "snapshot_id", small) if upgrades else found
