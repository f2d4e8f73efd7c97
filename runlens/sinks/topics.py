"""Topic writers: message text in column `value`."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import messages as M
from runlens.operators.runs import union_all


def to_messages(rows: DataFrame, message_type: str, *keep: str) -> DataFrame:
    """Rows of one kind of message as message text.

    Forms need (player_id, form), predictions (player_id, prediction), triggers (run_id,
    encounter_id, boss_archetype), results (player_id, encounter_id, dialogue, choices).
    """
    value = {
        C.FORM_MESSAGE: lambda: M.form_message(F.col("player_id"), F.col("form")),
        C.PREDICTION_MESSAGE: lambda: M.prediction_message(
            F.col("player_id"), F.col("prediction")),
        C.TRIGGERS_TOPIC: lambda: M.trigger_message(
            F.col("run_id"), F.col("encounter_id"), F.col("boss_archetype")),
        C.RESULT_MESSAGE: lambda: M.result_message(
            F.col("player_id"), F.col("encounter_id"), F.col("dialogue"), F.col("choices")),
    }[message_type]()
    return rows.select(*keep, value.alias("value"))


def write_topic(messages: DataFrame, topic: str, fmt: str = "kafka", **options: str) -> None:
    """Write a batch of messages: to a Kafka topic, or with `path` to a folder per topic.

    With `batch` a folder write replaces an earlier try of that batch. Kafka needs the connector
    on the class path and `kafka__bootstrap__servers`.
    """
    settings = {key.replace("__", "."): value for key, value in options.items()}
    if fmt == "kafka":
        write_topics({topic: messages}, **options)
    else:
        path = f"{settings.pop('path')}/{topic}"
        batch = settings.pop("batch", None)
        path = path if batch is None else f"{path}/batch={batch}"
        mode = "append" if batch is None else "overwrite"
        messages.select("value").write.format(fmt).options(**settings).mode(mode).save(path)


def write_topics(messages: Mapping[str, DataFrame], **options: str) -> None:
    """Write the messages of several Kafka topics at once."""
    settings = {key.replace("__", "."): value for key, value in options.items()}
    rows = union_all(*[frame.select(F.lit(topic).alias("topic"), "value")
                       for topic, frame in messages.items()])
    rows.write.format("kafka").options(**settings).save()
