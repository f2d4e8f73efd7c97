"""Adaptation messages: enemy forms from kills, and predictions from dashes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.vectors import cosine2, dash_direction
from runlens.operators.features import run_player
from runlens.operators.runs import ORDER, RunFrame, by_run, large_keys
from runlens.sources.events import filter_type

_DIRECTIONS = ("up", "down", "left", "right")


def changes(frame: RunFrame, column: str, initial: str) -> DataFrame:
    """Rows whose value differs from the one before; the first compares with `initial`."""
    before = F.lag(column, 1, initial).over(frame.window())
    return frame.on(frame.df.withColumn("_before", before)).own().filter(
        F.col(column) != F.col("_before")).drop("_before")


# --- kills ---------------------------------------------------------------------------------------

def _kill_rows(events: DataFrame) -> DataFrame:
    moved = F.col("event_type") == C.MOVEMENT
    return filter_type(events, C.MOVEMENT, C.KILL).select(
        "run_id", *ORDER, moved.alias("moved"), "x", "y",
        F.when(moved, F.col("x")).alias("vx"), F.when(moved, F.col("y")).alias("vy"))


def _velocity(frame: RunFrame) -> RunFrame:
    frame = frame.with_totals(lasts=("vx", "vy"))
    running = frame.running()
    rows = frame.df.withColumns({
        name: F.coalesce(F.last(name, ignorenulls=True).over(running), F.lit(0.0))
        for name in ("vx", "vy")})
    return frame.on(rows.filter(~F.col("moved"))).settled()


def carry_velocity(events: DataFrame) -> DataFrame:
    """Kills with the player's latest movement vector, (0,0) before any."""
    return by_run(_kill_rows(events), lambda frame: _velocity(frame).result(
        "run_id", *ORDER, "x", "y", "vx", "vy"))


def _alignment(frame: RunFrame, last_n: int, min_n: int) -> RunFrame:
    """Mean cosine of the last kills that have one, on every kill that follows them.

    The sum runs from the newest kill to the oldest: decisions compare the mean with a threshold,
    so its last bit matters.
    """
    cosine = cosine2(F.col("vx"), F.col("vy"), F.col("x"), F.col("y"))
    frame = frame.on(frame.df.withColumn("cosine", cosine))
    frame = frame.with_tail(last_n, ["cosine"], F.col("cosine").isNotNull())
    rows = frame.df.withColumn("_has", F.col("cosine").isNotNull())
    recent = F.reverse(F.collect_list("cosine").over(frame.last_rows(last_n, "_has")))
    rows = rows.withColumn("_recent", F.when(F.col("_has"), recent))
    total = F.aggregate("_recent", F.lit(0.0), lambda sofar, value: sofar + value)
    rows = rows.withColumn("_state", F.when(F.col("_has"), F.struct(
        F.size("_recent").alias("n"), (total / F.size("_recent")).alias("mean"))))
    state = F.last("_state", ignorenulls=True).over(frame.running())
    rows = rows.withColumn("_state", state).withColumn(
        "alignment", F.when(F.col("_state.n") >= min_n, F.col("_state.mean")))
    return frame.on(rows.drop("_has", "_recent", "_state")).settled()


def kill_alignment(events: DataFrame, last_n: int = C.KILL_HISTORY,
                   min_n: int = C.KILL_MIN) -> DataFrame:
    return by_run(_kill_rows(events), lambda frame: _alignment(
        _velocity(frame), last_n, min_n).result("run_id", *ORDER, "cosine", "alignment"))


def _opposite(form: Column) -> Column:
    return F.when(form == C.JUGGERNAUT, C.SKIRMISHER).otherwise(C.JUGGERNAUT)


def _form_scan(rows: DataFrame, running: WindowSpec, initial: Column) -> DataFrame:
    """Form after each row: the last fixed form, turned once per flip since.

    The recurrence "flip the current form" needs no loop: only the parity of flips counts.
    Adds `anchor`, the last fixed form or null, `turned`, the parity since, and `form`.
    """
    rows = rows.withColumn("_flips", F.sum("flip").over(running))
    fixed = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "_flips"))
    rows = rows.withColumn("_anchor", F.last(fixed, ignorenulls=True).over(running))
    turned = (F.col("_flips") - F.coalesce("_anchor._flips", F.lit(0))) % 2 == 1
    base = F.coalesce("_anchor.fixed", initial)
    return rows.withColumn("turned", turned).withColumn("anchor", F.col("_anchor.fixed")).withColumn(
        "form", F.when(F.col("turned"), _opposite(base)).otherwise(base)).drop(
            "_flips", "_anchor")


def _forms(frame: RunFrame) -> RunFrame:
    mean = F.col("alignment")
    fixed = F.when(mean < C.JUGGERNAUT_BELOW, C.JUGGERNAUT).when(
        mean > C.SKIRMISHER_ABOVE, C.SKIRMISHER)
    rows = frame.df.withColumn("fixed", fixed).withColumn(
        "flip", F.when(mean.isNotNull() & F.col("fixed").isNull(), 1).otherwise(0))
    frame = frame.on(rows)
    start = F.lit(C.SKIRMISHER)
    if frame.split:
        # A chunk as a whole either ends in a fixed form or turns the incoming one.
        inside = _form_scan(frame.own(), frame.running(), start)
        ends = inside.groupBy(*frame.keys).agg(F.max_by(
            F.struct("anchor", "turned", "form"), F.struct(*frame.order_by)).alias("end"))
        chunks = ends.select(
            *frame.keys, F.when(F.col("end.anchor").isNotNull(), F.col("end.form")).alias("fixed"),
            F.when(F.col("end.anchor").isNull() & F.col("end.turned"), 1).otherwise(0).alias(
                "flip"))
        order = Window.partitionBy(*frame.by).orderBy("chunk")
        after = _form_scan(chunks, order.rowsBetween(
            Window.unboundedPreceding, Window.currentRow), start)
        incoming = after.select(*frame.keys, F.lag("form").over(order).alias("fixed"))
        frame = frame.with_rows(
            incoming.filter("fixed is not null").withColumn("flip", F.lit(0)))
    return frame.on(_form_scan(frame.df, frame.running(), start))


def brute_forms(events: DataFrame, last_n: int = C.KILL_HISTORY,
                min_n: int = C.KILL_MIN) -> DataFrame:
    """Enemy form after each kill.

    A low mean fixes one form, a high mean the other, any mean between flips the current form, and
    too few kills keep it.
    """
    return by_run(_kill_rows(events), lambda frame: _forms(_alignment(
        _velocity(frame), last_n, min_n)).result("run_id", *ORDER, "alignment", "form"))


def form_changes(events: DataFrame, last_n: int = C.KILL_HISTORY,
                 min_n: int = C.KILL_MIN) -> DataFrame:
    """Kills that change the enemy form, with the new form."""
    return by_run(_kill_rows(events), _form_changes(last_n, min_n))


def _form_changes(last_n: int, min_n: int) -> Callable[[RunFrame], DataFrame]:
    return lambda frame: changes(_forms(_alignment(
        _velocity(frame), last_n, min_n)), "form", C.SKIRMISHER).select("run_id", *ORDER, "form")


def stale_forms(events: DataFrame, horizon: int, stale_ms: int = C.STALE_MS,
                grace_ms: int = C.GRACE_MS, last_n: int = C.KILL_HISTORY,
                min_n: int = C.KILL_MIN) -> DataFrame:
    """Form messages with staleness, up to the time `horizon`: (run_id, moment, form, is_stale).

    `stale_ms` after a message without a next one the form flips, and kills are ignored for
    `grace_ms`. With a grace at least as long as the stale period no kill counts after the first
    stale flip, so the rest of the run is a fixed rhythm. A shorter grace makes each decision
    depend on the timers before it; the stream processor handles that case.
    """
    if grace_ms < stale_ms:
        raise ValueError("a grace shorter than the stale period needs the stream processor")
    kills = _kill_rows(events)
    small = large_keys(kills) is None
    messages = by_run(kills, _form_changes(last_n, min_n), checked=small).filter(
        F.col("timestamp") <= horizon)

    def work(frame: RunFrame) -> DataFrame:
        frame = frame.with_tail(1, [])
        before = F.lag("timestamp").over(frame.window())
        late = F.coalesce((F.col("timestamp") - before >= stale_ms).cast("int"), F.lit(0))
        frame = frame.on(frame.df.withColumn("late", late)).settled().with_totals(sums=("late",))
        seen = F.sum("late").over(frame.running())
        return frame.on(frame.df.withColumn("seen", seen)).own().filter("seen = 0").select(
            "run_id", *ORDER, "form")

    live = by_run(messages, work, checked=small)
    ends = live.groupBy("run_id").agg(
        F.max("timestamp").alias("last"), F.max_by("form", F.struct(*ORDER)).alias("form"))
    rounds = F.floor((F.lit(horizon) - F.col("last")) / stale_ms)
    flips = ends.filter(rounds >= 1).select(
        "run_id", "last", "form", F.explode(F.sequence(F.lit(1).cast("long"), rounds)).alias("i"))
    odd = F.col("i") % 2 == 1
    stale = flips.select(
        "run_id", (F.col("last") + F.col("i") * stale_ms).alias("moment"),
        F.when(odd, _opposite(F.col("form"))).otherwise(F.col("form")).alias("form"),
        F.lit(True).alias("is_stale"))
    return live.select("run_id", F.col("timestamp").alias("moment"), "form",
                       F.lit(False).alias("is_stale")).unionByName(stale)


# --- dashes --------------------------------------------------------------------------------------

def _dash_rows(events: DataFrame) -> DataFrame:
    return filter_type(events, C.DASH).select(
        "run_id", *ORDER, dash_direction(F.col("x"), F.col("y")).alias("direction"),
        F.col("timestamp").alias("since"))


def _frequency(recent: str, name: str) -> Column:
    """How often, and how recently, a name stands in a list that begins with the newest."""
    times = F.size(F.filter(recent, lambda seen: seen == name))
    return F.struct(times.alias("times"), (-F.array_position(recent, name)).alias("recency"),
                    F.lit(name).alias("name"))


def _modes(frame: RunFrame, last_n: int) -> RunFrame:
    """Most frequent of the last directions; of equals, the one seen most recently."""
    frame = frame.with_totals(firsts=("since",)).with_tail(last_n, ["direction"])
    rows = frame.df.withColumns({
        "_recent": F.reverse(F.collect_list("direction").over(frame.last_rows(last_n))),
        "since": F.first("since", ignorenulls=True).over(frame.running()),
    })
    ranked = [_frequency("_recent", name) for name in _DIRECTIONS]
    return frame.on(rows.withColumn("prediction", F.greatest(*ranked)["name"]).drop("_recent"))


def dash_mode(events: DataFrame, last_n: int = C.DASH_HISTORY) -> DataFrame:
    """Predicted direction after each dash."""
    return by_run(_dash_rows(events), lambda frame: _modes(frame, last_n).result(
        "run_id", *ORDER, "direction", "prediction"))


def prediction_updates(events: DataFrame, tick_ms: int = C.PREDICTION_TICK_MS,
                       last_n: int = C.DASH_HISTORY) -> DataFrame:
    """Predictions that changed: (run_id, moment, prediction).

    A run's clock ticks every `tick_ms` from its first dash on; a tick looks at the dashes up to
    and including its own moment. Only the last dash of a tick can change the prediction, so ticks
    without a dash need no row.
    """

    def work(frame: RunFrame) -> DataFrame:
        frame = _modes(frame, last_n)
        tick = F.greatest(
            F.ceil((F.col("timestamp") - F.col("since")) / tick_ms), F.lit(1)).cast("long")
        last = F.struct(*ORDER, *(["chunk"] if frame.split else []), "since", "prediction")
        ticks = frame.own().withColumn("tick", tick).groupBy("run_id", "tick").agg(
            F.max(last).alias("last"))
        rows = ticks.select("run_id", "tick", "last.*")
        if frame.split:
            rows = rows.withColumn("lead_in", F.lit(2))
        frame = replace(frame, df=rows, order_by=("tick",)).settled().with_tail(1, ["prediction"])
        return changes(frame, "prediction", C.NO_PREDICTION).select(
            "run_id", (F.col("since") + F.col("tick") * tick_ms).alias("moment"), "prediction")

    return by_run(_dash_rows(events), work)


def with_player(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add the player of the run's first event."""
    return rows.join(run_player(events), "run_id")
