"""Schemas of events, feature vectors, training tables and the record lake."""

from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("player_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("payload", T.StringType()),
])

FIGHT_EVENT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])

TRIGGER_MESSAGE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("encounter_id", T.StringType()),
    T.StructField("boss_archetype", T.StringType()),
    T.StructField("reply", T.StringType()),
])

WAITING_FIGHT = T.StructType([
    *[T.StructField(name, T.StringType()) for name in ("run_id", "boss_archetype", "event_type",
                                                       "encounter_id")],
    T.StructField("win", T.BooleanType()), T.StructField("tries", T.IntegerType()),
])

#: Counts of one micro-batch of an enrichment job.
AUDIT = T.StructType([T.StructField(name, T.LongType()) for name in (
    "loaded", "enriched", "expired", "oversampled", "persisted")])

SESSION_EVENT = T.StructType([T.StructField("event_type", T.StringType())])


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Scalars stay text: a value of the wrong kind must fall back to its default, not void the event.
PAYLOAD = T.StructType([
    T.StructField("dir", _texts("dx", "dy")),
    T.StructField("direction", _texts("dx", "dy")),
    T.StructField("velocity", _texts("vx", "vy")),
    *_texts(
        "dmg_amount", "is_elite_source", "hp", "max_hp", "chosen_upgrade_id", "encounter_id",
        "boss_archetype", "win",
    ).fields,
])

# One gameplay event with its payload as columns. (timestamp, event_id) orders the events of a run;
# event_id is a source position (offset, row id) or a stable hash of the record.
FLAT_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("player_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("dmg_amount", T.DoubleType()),
    T.StructField("is_elite_source", T.BooleanType()),
    T.StructField("hp", T.DoubleType()),
    T.StructField("max_hp", T.DoubleType()),
    T.StructField("chosen_upgrade_id", T.StringType()),
    T.StructField("encounter_id", T.StringType()),
    T.StructField("boss_archetype", T.StringType()),
    T.StructField("win", T.BooleanType()),
])

_FEATURES = [
    T.StructField("total_dashes", T.LongType()),
    T.StructField("total_damage_dealt", T.DoubleType()),
    T.StructField("total_damage_taken", T.DoubleType()),
    T.StructField("damage_taken_from_elites", T.DoubleType()),
    T.StructField("avg_hp_percent", T.DoubleType()),
    T.StructField("upgrade_counts", T.MapType(T.StringType(), T.IntegerType())),
]
NUMERIC_FEATURES = tuple(field.name for field in _FEATURES[:-1])

TRAINING = T.StructType([*_FEATURES, T.StructField("outcome", T.IntegerType())])

FEATURE_VECTOR = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("encounterId", T.StringType()),
    *_FEATURES,
    T.StructField("outcome", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
])

LAKE = T.StructType([
    T.StructField("boss_archetype", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("encounterId", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    *TRAINING.fields,
])

EFFECT = T.StructType([
    T.StructField("targetStat", T.StringType()),
    T.StructField("modifier", T.DoubleType()),
    T.StructField("isPercentage", T.BooleanType()),
    T.StructField("duration", T.IntegerType()),
])

COMMENT_REQUEST = T.StructType([
    T.StructField("npc_personality", T.StringType()),
    T.StructField("statistic_to_comment_on", _texts("Key", "Value")),
])
