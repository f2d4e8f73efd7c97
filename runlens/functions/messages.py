"""JSON messages of the outgoing topics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.vectors import unit_vector


def envelope(message_type: str, payload: Column) -> Column:
    """Message text whose payload is JSON text itself."""
    return F.to_json(F.struct(
        F.lit(message_type).alias("message_type"), F.to_json(payload).alias("payload")))


def form_message(player_id: Column, form: Column) -> Column:
    return envelope(C.FORM_MESSAGE, F.struct(
        player_id.alias("playerId"), form.alias("adaptation_type")))


def prediction_message(player_id: Column, direction: Column) -> Column:
    return envelope(C.PREDICTION_MESSAGE, F.struct(
        player_id.alias("playerId"), unit_vector(direction).alias("predicted_direction")))


def trigger_message(run_id: Column, encounter_id: Column, archetype: Column) -> Column:
    """Encounter trigger; it is sent without an envelope."""
    return F.to_json(F.struct(
        run_id.alias("run_id"),
        F.coalesce(encounter_id, F.lit(C.DEFAULT_ENCOUNTER)).alias("encounter_id"),
        archetype.alias("boss_archetype"),
    ))


def result_message(player_id: Column, encounter_id: Column, dialogue: Column,
                   choices: Column) -> Column:
    return envelope(C.RESULT_MESSAGE, F.struct(
        F.coalesce(player_id, F.lit("unknown")).alias("playerId"),
        encounter_id.alias("encounterId"), dialogue.alias("dialogue"),
        choices.alias("choices")))
