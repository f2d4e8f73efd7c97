"""Offers: bargain effects picked by the leading features, worded and scaled by confidence.

Input rows hold run_id, encounter_id, player_id, prediction, confidence, primary_feature,
secondary_feature and, once replies are there, the reply text. A row without a prediction or a
readable reply gets a fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.functions import effects as E
from runlens.functions import text
from runlens.schemas import EFFECT

_CHOICE = "struct<description:string,buffs:array<{e}>,debuffs:array<{e}>>".format(
    e=EFFECT.simpleString())
_KEY = ("run_id", "encounter_id")


def bargain_table(spark: SparkSession) -> DataFrame:
    """(feature, polarity, effects): a fixed dozen of rows."""
    rows = [(feature, polarity, list(pool)) for feature, buffs, debuffs in C.BARGAINS
            for polarity, pool in (("buffs", buffs), ("debuffs", debuffs))]
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("polarity", T.StringType()),
        T.StructField("effects", T.ArrayType(EFFECT))]))


def template_table(spark: SparkSession) -> DataFrame:
    """(prompt_type, template): two fixed rows."""
    return spark.createDataFrame(list(C.PROMPTS.items()), "prompt_type string, template string")


def bargain_pool(rows: DataFrame, feature: str, pool: str) -> DataFrame:
    """Add the effects of `feature` for the row's polarity, those of `default` when unmapped."""
    table = bargain_table(rows.sparkSession)
    of_feature = F.broadcast(table.withColumnsRenamed({"feature": feature, "effects": "_own"}))
    default = F.broadcast(table.filter(F.col("feature") == C.DEFAULT_FEATURE).select(
        "polarity", F.col("effects").alias("_default")))
    return rows.join(of_feature, [feature, "polarity"], "left").join(
        default, "polarity", "left").withColumn(
            pool, F.coalesce("_own", "_default")).drop("_own", "_default")


def with_template(rows: DataFrame) -> DataFrame:
    """Add the prompt of the predicted outcome; rows without a prediction have none."""
    templates = F.broadcast(template_table(rows.sparkSession))
    return rows.withColumn("prompt_type", F.lower("prediction")).join(
        templates, "prompt_type", "left")


def render_prompt(rows: DataFrame) -> DataFrame:
    prompt = text.bargain_prompt(
        F.col("template"), F.col("primary_feature"), F.col("secondary_feature"))
    return with_template(rows).withColumn("prompt", prompt).drop("template", "prompt_type")


def scaled_effect(pool: Column, confidence: Column, slot: int) -> Column:
    """One effect of the pool, the same on every retry, with its modifier scaled."""
    chosen = E.choose(pool, *[F.col(name) for name in _KEY], F.lit(str(slot)))
    return chosen.withField("modifier", E.scale_modifier(chosen["modifier"], confidence))


def _choice(description: Column, effect: Column, is_buff: Column) -> Column:
    one, none = F.array(effect), F.array().cast(T.ArrayType(EFFECT))
    return F.struct(
        description.alias("description"),
        F.when(is_buff, one).otherwise(none).alias("buffs"),
        F.when(is_buff, none).otherwise(one).alias("debuffs")).cast(_CHOICE)


def offers(scored: DataFrame, reply: str = "reply") -> DataFrame:
    """Add `dialogue` and `choices` to scored rows that have reply texts.

    Every step is a column expression or a join with a fixed table, so the rows are never shuffled.
    """
    rows = scored.withColumn("polarity", E.polarity(F.col("prediction")))
    rows = bargain_pool(rows, "primary_feature", "_pool_0")
    rows = bargain_pool(rows, "secondary_feature", "_pool_1")
    parsed = text.parse_reply(F.col(reply))
    rows = rows.withColumn("_reply", F.when(F.col("prediction").isNotNull(), parsed))
    is_buff = F.col("polarity") == "buffs"
    for slot in (0, 1):
        effect = scaled_effect(F.col(f"_pool_{slot}"), F.col("confidence"), slot)
        rows = rows.withColumn(f"_effect_{slot}", effect)
    made = [_choice(
        E.describe(E.description_at(F.col("_reply.descriptions"), slot),
                   F.col(f"_effect_{slot}")), F.col(f"_effect_{slot}"), is_buff)
        for slot in (0, 1)]
    answered = F.col("_reply").isNotNull()
    return rows.withColumns({
        "dialogue": F.when(answered, F.col("_reply.dialogue")).otherwise(C.FALLBACK_DIALOGUE),
        "choices": F.when(answered, F.array(*made)).otherwise(fallback_choices()),
    }).drop("polarity", "_reply", "_pool_0", "_pool_1", "_effect_0", "_effect_1")


def _fallback_pool(entries, is_buff: bool) -> Column:
    choices = []
    for description, (stat, modifier, percentage, duration) in entries:
        effect = F.struct(F.lit(stat).alias("targetStat"), F.lit(modifier).alias("modifier"),
                          F.lit(percentage).alias("isPercentage"),
                          F.lit(duration).alias("duration"))
        choices.append(_choice(F.lit(description), effect, F.lit(is_buff)))
    return F.array(*choices)


def fallback_choices() -> Column:
    """Two different choices of one pool, pool and choices picked by (run_id, encounter_id)."""
    key = [F.coalesce(F.col(name), F.lit("")) for name in _KEY]
    buffs = F.pmod(E.keyed_number(*key, F.lit("pool")), F.lit(2)) == 0
    pool = F.when(buffs, _fallback_pool(C.FALLBACK_BUFFS, True)).otherwise(
        _fallback_pool(C.FALLBACK_DEBUFFS, False))
    return E.choose_many(pool, 2, *key)


def triggers_with_features(triggers: DataFrame, features: DataFrame) -> DataFrame:
    """Encounter triggers with the cached features of their run; without features they drop out.

    Triggers without a run or encounter are dropped as well.
    """
    usable = triggers.filter(F.col("run_id").isNotNull() & F.col("encounter_id").isNotNull())
    cached = features.drop("boss_archetype", "encounter_id", "encounterId", "timestamp",
                           "event_id", "event_type")
    return usable.join(cached, "run_id")
