"""Typed access to event payloads, and the labels derived from them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import constants as C


def safe(text: Column, kind: str, default=None) -> Column:
    """`text` as `kind`; a missing or unreadable value gives `default`."""
    if kind == "boolean":
        # Only the words true and false count, in any case.
        lowered = F.lower(text)
        value = F.when(lowered == "true", True).when(lowered == "false", False)
    else:
        value = text.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def payload_field(payload: Column, path: str, kind: str = "string", default=None) -> Column:
    """Field at a dotted path of a JSON payload."""
    return safe(F.get_json_object(payload, f"$.{path}"), kind, default)


def component(vector: Column, name: str) -> Column:
    """Vector component: 0 when absent, null when the vector is absent or the value no number."""
    text = vector[name]
    return F.when(vector.isNotNull(), F.when(text.isNull(), F.lit(0.0)).otherwise(
        text.try_cast("double")))


def outcome(win: Column) -> Column:
    """1 for a won fight, else 0; an unknown result is a loss."""
    return F.when(win, 1).otherwise(0)


def fight_weight(event_type: Column) -> Column:
    return F.when(event_type == C.BOSS_DONE, C.BOSS_WEIGHT).otherwise(C.ELITE_WEIGHT)


def usable_archetype(archetype: Column) -> Column:
    """True unless the archetype is missing or `none`, in any case."""
    return F.lower(F.coalesce(archetype, F.lit(C.NO_ARCHETYPE))) != C.NO_ARCHETYPE


def encounter_or_new(encounter_id: Column, run_id: Column, timestamp: Column) -> Column:
    """Encounter id, or one derived from the event, so that a retry gives the same id."""
    return F.coalesce(encounter_id, F.sha2(F.concat(run_id, timestamp.cast("string")), 256))
