"""Bargain effects: scaling, wording and keyed choice."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import constants as C


def scale_modifier(base: Column, confidence: Column, factor: float = C.CONFIDENCE_SCALING) -> Column:
    """Modifier grown with the square of the confidence above one half."""
    certainty = (F.greatest(confidence, F.lit(C.DEFAULT_CONFIDENCE)) - 0.5) * 2
    return F.round(base * (1 + F.lit(factor) * F.pow(certainty, F.lit(2.0))), 3)


def effect_text(effect: Column) -> Column:
    """Wording such as `(+20% Max HP)`; numbers are cut towards zero."""
    names = F.create_map(*[F.lit(text) for pair in C.STAT_NAMES.items() for text in pair])
    modifier = F.coalesce(effect["modifier"], F.lit(0.0))
    amount = F.when(
        F.coalesce(effect["isPercentage"], F.lit(False)),
        F.concat((modifier * 100).cast("int").cast("string"), F.lit("%")),
    ).otherwise(modifier.cast("int").cast("string"))
    stat = F.coalesce(names[effect["targetStat"]], effect["targetStat"], F.lit(""))
    sign = F.when(modifier >= 0, "+").otherwise("")
    return F.concat(F.lit("("), sign, amount, F.lit(" "), stat, F.lit(")"))


def describe(text: Column, effect: Column) -> Column:
    return F.concat_ws(" ", text, effect_text(effect))


def description_at(descriptions: Column, index: int) -> Column:
    """Description at a position, or `Choice n` when the list is too short."""
    return F.coalesce(F.get(descriptions, F.lit(index)), F.lit(f"Choice {index + 1}"))


def keyed_number(*parts: Column) -> Column:
    """Whole number in [0, 2^32) that depends on the parts only: repeatable choice per key."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def choose(pool: Column, *parts: Column) -> Column:
    """One element of `pool`, picked by the key `parts`."""
    return F.get(pool, F.pmod(keyed_number(*parts), F.size(pool)).cast("int"))


def choose_many(pool: Column, count: int, *parts: Column) -> Column:
    """`count` different elements of `pool`, in an order picked by the key `parts`."""
    ranked = F.array_sort(F.transform(pool, lambda item, at: F.struct(
        keyed_number(*parts, at.cast("string")).alias("draw"), at.alias("at"),
        item.alias("item"))))
    return F.transform(F.slice(ranked, 1, count), lambda drawn: drawn["item"])


def polarity(prediction: Column) -> Column:
    """A predicted loss is offered buffs, a predicted win debuffs."""
    return F.when(prediction == "Loss", "buffs").otherwise("debuffs")


def prediction_label(predicted: Column) -> Column:
    return F.when(predicted == 1, "Win").otherwise("Loss")
