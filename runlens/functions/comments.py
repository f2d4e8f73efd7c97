"""Commentary requests: validation and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.text import clean_reply, comment_prompt

_FACT = "statistic_to_comment_on"


def valid_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) requests; a usable one names a statistic and its value."""
    fact = F.col(_FACT)
    complete = fact.isNotNull() & fact["Key"].isNotNull() & fact["Value"].isNotNull()
    filled = requests.withColumn(
        "npc_personality", F.coalesce("npc_personality", F.lit(C.DEFAULT_PERSONALITY)))
    return filled.filter(complete), requests.filter(~complete)


def with_comment_prompt(requests: DataFrame) -> DataFrame:
    fact = F.col(_FACT)
    return requests.withColumn("prompt", comment_prompt(
        F.col("npc_personality"), fact["Key"], fact["Value"]))


def with_clean_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("comment", clean_reply(F.col(reply)))
