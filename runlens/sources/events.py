"""Gameplay events: reading, JSON decoding, bad-record handling and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.functions import payload as P
from runlens.schemas import ENVELOPE, FIGHT_EVENT, PAYLOAD

CORRUPT = "_corrupt_record"


def read_events(spark: SparkSession, fmt: str = "kafka", streaming: bool = True,
                path: str | None = None, schema: T.StructType | None = None,
                **options: str) -> DataFrame:
    """Event records with a text column `value`.

    `kafka` needs the connector on the class path and takes its options (`subscribe`,
    `kafka.bootstrap.servers`, `maxOffsetsPerTrigger`) with `__` for `.`; offset and partition are
    kept as the order of the records. `text`, `json` and `parquet` read a folder.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**{k.replace("__", "."): v for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "kafka":
        return reader.load().select(
            F.col("value").cast("string"), record_id(F.col("partition"), F.col("offset")).alias(
                "event_id"), F.col("timestamp").alias("record_time"))
    return reader.load(path)


def record_id(partition: Column, offset: Column) -> Column:
    """Id of a topic record: offsets repeat across partitions, which take the top 15 bits."""
    return F.shiftleft(partition.cast("long"), 48) + offset


def delivered_once(events: DataFrame) -> DataFrame:
    """Events without those delivered again: topics deliver at least once.

    Records with equal run, time and event id are one event. A stream needs the state of a
    watermark for the same (`dropDuplicatesWithinWatermark`).
    """
    return events.dropDuplicates(["run_id", "timestamp", "event_id"])


def _parse(records: DataFrame, column: str, schema: T.StructType, keep: tuple[str, ...],
           **options: str) -> DataFrame:
    """JSON text in `column` as columns of `schema`, beside the columns `keep`.

    `inline` makes the parse a step of its own: a filter on parsed fields stays above it, where a
    plain projection would be copied into the filter and parse each record several times.
    """
    return records.select(*keep, F.inline(F.array(F.from_json(column, schema, options))))


def decode_events(records: DataFrame, schema: T.StructType = ENVELOPE,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON text column `value` as columns of `schema`; fields outside the schema are ignored."""
    return _parse(records, "value", schema, keep)


_MARKED = T.StructType([*ENVELOPE.fields, T.StructField(CORRUPT, T.StringType())])


def _checked(records: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Parsed records with their text, the envelope's fields, and whether they are an event."""
    parsed = _parse(records, "value", _MARKED, tuple(dict.fromkeys((*keep, "value"))),
                    columnNameOfCorruptRecord=CORRUPT)
    good = (
        F.col(CORRUPT).isNull() & F.col("event_type").isNotNull() & F.col("run_id").isNotNull()
        & F.coalesce(F.ltrim("payload").startswith("{"), F.lit(True))
    )
    return parsed.withColumns({
        "good": good, "timestamp": F.coalesce("timestamp", F.lit(0)).cast("long")}).drop(CORRUPT)


def split_valid(records: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Decoded events, and the raw records that cannot be one.

    Quarantined: text that is no JSON object, a field of the wrong kind, a payload that is no
    object, a missing event type, and a missing run id, which no per-run step could place.
    """
    checked = _checked(records, keep)
    return (checked.filter("good").select(*keep, *ENVELOPE.fieldNames()),
            checked.filter("not good").select(*keep, "value"))


def checked_events(records: DataFrame) -> DataFrame:
    """All records in one pass: flat events, and beside them the text and whether it is `good`.

    A record without an `event_id` is known by a hash of its text. The payload of an event is kept
    as a variant, with fields that no column has. Columns of other records are null.
    """
    if "event_id" not in records.columns:
        records = records.withColumn("event_id", F.xxhash64("value"))
    checked = _checked(records, ("event_id",))
    payload = F.when(F.col("good"), F.try_parse_json("payload")).alias("payload")
    flat = _flat(checked.withColumn("text", F.when(F.col("good"), F.col("payload"))), "text",
                 "value", "good", "payload")
    names = [name for name in flat.columns if name not in ("event_id", "value", "good", "payload")]
    return flat.select(
        "event_id", *[F.when(F.col("good"), F.col(name)).alias(name) for name in names],
        "value", "good", payload)


def flatten_payload(events: DataFrame, once: bool = True) -> DataFrame:
    """Decoded events with one column per payload field and defaults for unreadable values.

    A movement, dash or kill whose vector is missing or unreadable has no effect and is dropped.
    Events delivered again count once; a stream leaves that to the ingest job, which bounds what it
    remembers, as does `once=False` for events that are known to be different.
    """
    if "event_id" not in events.columns:
        events = events.withColumn("event_id", F.xxhash64(*events.columns))
    if once and not events.isStreaming:
        events = delivered_once(events)
    return usable_vectors(_flat(events, "payload"))


def _flat(events: DataFrame, payload: str, *keep: str) -> DataFrame:
    kind = F.col("event_type")
    vector = {C.MOVEMENT: ("dir", "dx", "dy"), C.DASH: ("direction", "dx", "dy"),
              C.KILL: ("velocity", "vx", "vy")}

    def along(axis: int):
        picked = F.lit(None).cast("double")
        for event_type, (field, *names) in vector.items():
            picked = F.when(kind == event_type, P.component(F.col(field), names[axis])).otherwise(
                picked)
        return picked

    envelope = ("event_id", "timestamp", "event_type", "player_id", "run_id")
    text = F.col
    return _parse(events, payload, PAYLOAD, (*envelope, *keep)).select(
        *envelope, along(0).alias("x"), along(1).alias("y"),
        P.safe(text("dmg_amount"), "double", 0.0).alias("dmg_amount"),
        P.safe(text("is_elite_source"), "boolean", False).alias("is_elite_source"),
        P.safe(text("hp"), "double", 1.0).alias("hp"),
        P.safe(text("max_hp"), "double", 1.0).alias("max_hp"),
        P.safe(text("chosen_upgrade_id"), "string", C.DEFAULT_UPGRADE).alias("chosen_upgrade_id"),
        "encounter_id", F.lower("boss_archetype").alias("boss_archetype"),
        text("win").try_cast("boolean").alias("win"), *keep,
    )


def usable_vectors(flat: DataFrame) -> DataFrame:
    needs = F.col("event_type").isin(C.MOVEMENT, C.DASH, C.KILL)
    return flat.filter(~F.coalesce(needs, F.lit(False))
                       | (F.col("x").isNotNull() & F.col("y").isNotNull()))


def filter_type(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(*types))


def known_events(events: DataFrame) -> DataFrame:
    """Events the profile reacts to; all others leave it as it is."""
    return filter_type(events, *C.PROFILE_EVENTS)


def guard_triggers(events: DataFrame) -> DataFrame:
    """Drop feature triggers without a usable archetype: they change no state at all."""
    trigger = F.col("event_type").isin(*C.TRIGGER_EVENTS)
    return events.filter(~trigger | P.usable_archetype(F.col("boss_archetype")))


def with_archetype(events: DataFrame) -> DataFrame:
    """Lower-case archetype; rows without a usable one are dropped."""
    return events.withColumn("boss_archetype", F.lower("boss_archetype")).filter(
        F.col("boss_archetype").isNotNull() & (F.col("boss_archetype") != C.NO_ARCHETYPE))


def decode_fights(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fight outcomes straight from records: the narrow schema skips all other payload parsing."""
    fights = filter_type(decode_events(records, FIGHT_EVENT, keep), *C.FIGHT_EVENTS)
    fights = fights.withColumn("boss_archetype", F.col("payload")["boss_archetype"])
    return with_archetype(fights).select(
        *keep, "run_id", "boss_archetype",
        F.col("payload")["win"].try_cast("boolean").alias("win"), "event_type",
        F.col("payload")["encounter_id"].alias("encounter_id"))
