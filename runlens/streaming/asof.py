"""Point-in-time join of fights and snapshots in the stream.

Each fight gets the newest snapshot of its run taken at or before it, in whatever order the two
arrive. Fights wait in keyed state beside the snapshots of their run. Once the watermark has passed
the time of a fight, no snapshot can still come before it, and it is answered; a fight without any is
`expired` and goes out beside the others instead of vanishing. Of the snapshots that the watermark
has passed, only the newest is kept, so state per run is bounded by what arrives within the delay.

Each call to the state store costs some 0.1 ms, whatever it moves, and a run needs a dozen of them in
a micro-batch. Where many runs have rows in each, `parts` puts the runs into so many parts by a hash,
and a part's rows of a micro-batch are read and written as one text.

The rules are those of the batch twin `fights_with_features`: at equal times an elite fight has its
own snapshot, a boss fight that of the largest event id.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runlens import constants as C
from runlens.operators.snapshots import TOTALS
from runlens.session import STATE_CHANGES_CONF, STATE_STORE, STATE_STORE_CONF

MATCHED, EXPIRED = "matched", "expired"
_SNAPSHOT, _FIGHT = "snapshot", "fight"

_TEXT, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
SHOT = T.StructType([
    T.StructField("timestamp", _LONG), T.StructField("event_id", _LONG),
    T.StructField("player_id", _TEXT), T.StructField("encounterId", _TEXT),
    T.StructField("total_dashes", _LONG), *[T.StructField(name, _DOUBLE) for name in TOTALS[1:]],
    T.StructField("avg_hp_percent", _DOUBLE), T.StructField("upgrades", _TEXT),
])
FIGHT = T.StructType([
    T.StructField("timestamp", _LONG), T.StructField("event_id", _LONG),
    T.StructField("event_type", _TEXT), T.StructField("boss_archetype", _TEXT),
    T.StructField("win", T.BooleanType()),
])
_RUN = T.StructField("run_id", _TEXT)
#: Rows of a part, their run first, as a JSON array of arrays.
CHUNK = T.StructType([T.StructField("rows", _TEXT)])
CHUNK_ROWS = 10_000
_ONLY_SHOT = [field for field in SHOT.fields if field.name not in ("timestamp", "event_id")]
OUTPUT = T.StructType([
    T.StructField("status", _TEXT), _RUN, *FIGHT.fields,
    T.StructField("snapshot_id", _LONG), *_ONLY_SHOT,
])
_OUTPUT_ROW = Row(*OUTPUT.fieldNames())


def _shot_place(shot: tuple) -> tuple:
    """Place of a snapshot in its run."""
    return shot[0], 0, shot[1]


def _fight_place(fight: tuple) -> tuple:
    return fight[0], int(fight[2] == C.BOSS_DONE), fight[1]


class AsOf(StatefulProcessor):
    """Waiting fights and recent snapshots of one run."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shots = handle.getListState("shots", SHOT)
        self.fights = handle.getListState("fights", FIGHT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        shots, fights = [], []
        for row in rows:
            if row.event_id is None:
                continue
            kind, into = (SHOT, shots) if row.kind == _SNAPSHOT else (FIGHT, fights)
            into.append(tuple(row[name] for name in kind.names))
        due = {fight[0] for fight in fights}
        if shots:
            self.shots.appendList(shots)
            # Older snapshots can go once the newest of these is passed.
            newest = max(shot[0] for shot in shots)
            due |= {newest, *([newest + self.idle_ms] if self.idle_ms else [])}
        if fights:
            self.fights.appendList(fights)
        for moment in due:
            self.handle.registerTimer(moment)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        # A list that is not there reads as empty: asking first would be one more call each.
        fights = [tuple(row) for row in self.fights.get()]
        shots = [tuple(row) for row in self.shots.get()]
        answers, left, kept = self._settle(key[0], fights, shots, passed)
        yield from answers
        if answers:
            self._put(self.fights, left)
        if len(kept) < len(shots):
            self._put(self.shots, kept)

    def _settle(self, run_id: str | None, fights: list[tuple], shots: list[tuple], passed: int,
                ) -> tuple[list[Row], list[tuple], list[tuple]]:
        """Answers to the fights of a run up to `passed`, fights that wait on, snapshots to keep."""
        shots = sorted(shots, key=_shot_place)
        ready = sorted((f for f in fights if f[0] <= passed), key=_fight_place)
        answers, at = [], 0
        for fight in ready:
            while at < len(shots) and _shot_place(shots[at]) <= _fight_place(fight):
                at += 1
            answers.append(self._answer(run_id, fight, shots[at - 1] if at else None))
        old = sum(shot[0] <= passed for shot in shots)
        kept = shots[max(0, old - 1):]
        if self.idle_ms and len(kept) == 1 == old and kept[0][0] + self.idle_ms <= passed:
            kept = []
        return answers, [f for f in fights if f[0] > passed] if ready else fights, kept

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    @staticmethod
    def _answer(run_id: str, fight: tuple, shot: tuple | None) -> Row:
        if shot is None:
            return _OUTPUT_ROW(EXPIRED, run_id, *fight, None, *[None] * len(_ONLY_SHOT))
        return _OUTPUT_ROW(MATCHED, run_id, *fight, shot[1], *shot[2:])


class AsOfParts(AsOf):
    """Waiting fights and recent snapshots of all runs of a part."""

    def __init__(self, idle_ms: int | None) -> None:
        super().__init__(idle_ms)
        self.settled: dict[int, int] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shots = handle.getListState("shots", CHUNK)
        self.fights = handle.getListState("fights", CHUNK)

    @staticmethod
    def _chunks(rows: list) -> list[tuple[str]]:
        return [(json.dumps(rows[at:at + CHUNK_ROWS]),) for at in range(0, len(rows), CHUNK_ROWS)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.settled.pop(key[0], None)
        shots, fights, places = [], [], None
        for row in rows:
            if places is None:
                names = list(row.__fields__)
                places = {kind: [names.index(name) for name in ("run_id", *fields.names)]
                          for kind, fields in ((_SNAPSHOT, SHOT), (_FIGHT, FIGHT))}
            if row.event_id is not None:
                (shots if row.kind == _SNAPSHOT else fights).append(
                    [row[at] for at in places[row.kind]])
        due = set()
        if shots:
            self.shots.appendList(self._chunks(shots))
            due.add(max(shot[1] for shot in shots))
            if self.idle_ms:
                due.add(min(shot[1] for shot in shots) + self.idle_ms)
        if fights:
            self.fights.appendList(self._chunks(fights))
            due.add(min(fight[1] for fight in fights))
        for moment in due:
            self.handle.registerTimer(moment)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.settled.get(key[0]) == passed:
            return  # the part's first timer of this micro-batch did it all
        self.settled[key[0]] = passed
        runs = defaultdict(lambda: ([], []))
        counts = []
        for number, state in enumerate((self.fights, self.shots)):
            counts.append(0)
            for chunk in state.get():
                for run_id, *row in json.loads(chunk[0]):
                    counts[number] += 1
                    runs[run_id][number].append(row)
        waiting, held, due = [], [], []
        for run_id, (fights, shots) in runs.items():
            answers, left, kept = self._settle(run_id, fights, shots, passed)
            yield from answers
            waiting += [[run_id, *fight] for fight in left]
            held += [[run_id, *shot] for shot in kept]
            # One timer waits for the first fight and the first idle run, and the next when it came.
            due += [fight[0] for fight in left]
            if self.idle_ms and kept and kept[-1][0] + self.idle_ms > passed:
                due.append(kept[-1][0] + self.idle_ms)
        if len(waiting) < counts[0]:
            self._put(self.fights, self._chunks(waiting))
        if len(held) < counts[1]:
            self._put(self.shots, self._chunks(held))
        if due:
            self.handle.registerTimer(min(due))


def asof_stream(fights: DataFrame, snapshots: DataFrame, delay: str = "10 seconds",
                idle_ms: int | None = C.IDLE_MS, parts: int | None = None) -> DataFrame:
    """Fights with their snapshot; column `status` tells matched from expired ones.

    `fights` have run_id, timestamp, event_id, event_type, boss_archetype and win; `snapshots` are
    feature vectors with `upgrade_counts`. The watermark is that of the slower input, so neither
    may be ahead of the other for good. A snapshot that no fight follows within `idle_ms` goes. A
    row without an event id moves the watermark only. With `parts` the state is kept by that many
    parts of the runs instead of by run; a checkpoint keeps the number it began with.
    """
    # Timers and list state need this state store, whatever session the caller built.
    fights.sparkSession.conf.set(STATE_STORE_CONF, STATE_STORE)
    fights.sparkSession.conf.set(STATE_CHANGES_CONF, "true")

    def placed(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumns({
            "kind": F.lit(kind), "event_time": F.timestamp_millis("timestamp")}).withWatermark(
                "event_time", delay)

    shots = snapshots.withColumn("upgrades", F.to_json("upgrade_counts")).select(
        "run_id", *SHOT.fieldNames())
    both = placed(fights.select("run_id", *FIGHT.fieldNames()), _FIGHT).unionByName(
        placed(shots, _SNAPSHOT), allowMissingColumns=True)
    if parts is None:
        return both.groupBy("run_id").transformWithState(
            AsOf(idle_ms), OUTPUT, "Append", "EventTime")
    return both.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(parts))).groupBy(
        "part").transformWithState(AsOfParts(idle_ms), OUTPUT, "Append", "EventTime")


def matched(output: DataFrame) -> DataFrame:
    """Fights with the features they started from."""
    return output.filter(F.col("status") == MATCHED).drop("status").withColumn(
        "upgrade_counts", F.from_json("upgrades", "map<string,int>")).drop("upgrades")


def expired(output: DataFrame) -> DataFrame:
    """Fights that no snapshot of their run came before."""
    return output.filter(F.col("status") == EXPIRED).select("run_id", *FIGHT.fieldNames())
