"""Literal boundary cases of the column expressions."""

import pytest
from conftest import values
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import comments, effects, payload, text, vectors
from runlens.models import offers as O
from runlens.models import outcome as M
from runlens.schemas import COMMENT_REQUEST


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("dx, dy, expected", [
    (0, 0, "down"), (1, 1, "up"), (-1, 1, "up"), (1, -1, "down"), (2, 1, "right"), (-2, 1, "left")])
def test_dash_direction(spark, dx, dy, expected):
    assert one(spark, vectors.dash_direction(F.lit(dx), F.lit(dy))) == expected


@pytest.mark.parametrize("name, vector", [
    ("up", (0, 1)), ("down", (0, -1)), ("left", (-1, 0)), ("right", (1, 0)), ("none", (0, 0))])
def test_unit_vector(spark, name, vector):
    assert tuple(one(spark, vectors.unit_vector(F.lit(name)))) == vector


def test_cosine_needs_two_lengths(spark):
    def cosine(*parts):
        return one(spark, vectors.cosine2(*[F.lit(float(part)) for part in parts]))

    assert cosine(0, 0, 1, 0) is None and cosine(1, 0, 0, 0) is None
    assert cosine(2, 0, 3, 0) == 1.0 and cosine(1, 0, -4, 0) == -1.0
    assert cosine(3, 4, 1, 0) == 0.6


def test_hp_ratio_needs_a_maximum(spark):
    assert one(spark, vectors.hp_ratio(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, vectors.hp_ratio(F.lit(5.0), F.lit(10.0))) == 0.5


@pytest.mark.parametrize("given, expected", [
    ("TRUE", True), ("false", False), ("maybe", False), ("1", False), (None, False)])
def test_safe_boolean(spark, given, expected):
    assert one(spark, payload.safe(F.lit(given).cast("string"), "boolean", False)) is expected


def test_unknown_result_is_a_loss(spark):
    assert one(spark, payload.outcome(F.lit("maybe").try_cast("boolean"))) == 0
    assert one(spark, payload.outcome(F.lit("true").try_cast("boolean"))) == 1


@pytest.mark.parametrize("base, confidence, expected", [
    (0.2, 0.4, 0.2), (0.2, 0.5, 0.2), (0.2, 1.0, 0.5), (20.0, 0.75, 27.5), (-0.15, 1.0, -0.375)])
def test_scale_modifier(spark, base, confidence, expected):
    assert one(spark, effects.scale_modifier(F.lit(base), F.lit(confidence))) == expected


@pytest.mark.parametrize("effect, expected", [
    (("MaxHealth", 0.2, True), "(+20% Max HP)"), (("DashCooldown", -0.149, True),
                                                  "(-14% Dash Cooldown)"),
    (("Armor", 20.0, False), "(+20 Armor)"), (("Luck", 0.0, False), "(+0 Luck)"),
    (("MoveSpeed", 0.29, True), "(+28% Move Speed)"), (("Armor", -14.9, False), "(-14 Armor)")])
def test_effect_text(spark, effect, expected):
    stat, modifier, percentage = effect
    column = F.struct(F.lit(stat).alias("targetStat"), F.lit(modifier).alias("modifier"),
                      F.lit(percentage).alias("isPercentage"))
    assert one(spark, effects.effect_text(column)) == expected


@pytest.mark.parametrize("reply, expected", [
    ('Sure: {"dialogue":"D","bargain_descriptions":["a","b"]} bye', ("D", ["a", "b"])),
    ('{"bargain_descriptions":["a"]}', (C.REPLY_DIALOGUE, ["a"])),
    ("{}", (C.REPLY_DIALOGUE, list(C.REPLY_DESCRIPTIONS))),
    ('line\n{"dialogue":\n"D"}\n', ("D", list(C.REPLY_DESCRIPTIONS))),
    ("no object", None), ("{broken", None), ("{broken}", None), (None, None)])
def test_parse_reply(spark, reply, expected):
    parsed = one(spark, text.parse_reply(F.lit(reply).cast("string")))
    assert (parsed and (parsed["dialogue"], parsed["descriptions"])) == expected


def test_description_list_too_short(spark):
    assert one(spark, effects.description_at(F.array(F.lit("a")), 1)) == "Choice 2"


def test_choices_differ_and_repeat(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("run_id"),
                                   F.lit("e").alias("encounter_id"))
    picked = rows.select("run_id", O.fallback_choices().alias("c"))
    first = {row["run_id"]: [c["description"] for c in row["c"]] for row in picked.collect()}
    again = {row["run_id"]: [c["description"] for c in row["c"]]
             for row in picked.repartition(7).collect()}
    assert first == again
    assert all(len(set(pair)) == 2 for pair in first.values())
    pools = [{d for d, _ in C.FALLBACK_BUFFS}, {d for d, _ in C.FALLBACK_DEBUFFS}]
    assert all(set(pair) <= pools[0] or set(pair) <= pools[1] for pair in first.values())
    assert {d for pair in first.values() for d in pair} == pools[0] | pools[1]


def test_comments(spark):
    requests = spark.createDataFrame([
        ("gruff", ("kills", "7")), (None, ("kills", "7")), ("gruff", None), ("gruff", (None, "7")),
        ("gruff", ("kills", None))], COMMENT_REQUEST)
    usable, rejected = comments.valid_requests(requests)
    prompts = [row["prompt"] for row in comments.with_comment_prompt(usable).collect()]
    assert rejected.count() == 3 and len(prompts) == 2
    assert all(prompt.count("\n") == 4 and prompt.endswith("'kills: 7'") for prompt in prompts)
    assert any(C.DEFAULT_PERSONALITY in prompt for prompt in prompts)
    assert one(spark, text.clean_reply(F.lit(' "Well" done\n'))) == "Well done"
    assert one(spark, text.clean_reply(F.lit(None).cast("string"))) == C.COMMENT_FALLBACK


def test_top_features_are_padded(spark):
    weights = spark.createDataFrame([
        ("melee", "a", -3.0), ("melee", "b", 2.0), ("melee", "c", 2.5), ("final", "a", 0.1)],
        "boss_archetype string, feature string, weight double")
    assert set(values(M.top_features(weights), "*")) == {
        ("melee", "a", "c"), ("final", "a", C.DEFAULT_FEATURE)}


def test_models_and_fallback(spark):
    """A separable archetype is learned; one without rows has no model and falls back."""
    rows = [("melee", i, float(i), 0.0, 0.0, 0.5, int(i >= 50)) for i in range(100)]
    training = spark.createDataFrame(rows, "boss_archetype string, total_dashes long, "
                                     "total_damage_dealt double, total_damage_taken double, "
                                     "damage_taken_from_elites double, avg_hp_percent double, "
                                     "outcome int")
    weights = M.train(training)
    assert {row["boss_archetype"] for row in weights.collect()} == {"melee"}
    asked = training.filter("total_dashes in (0, 99)").unionByName(
        training.filter("total_dashes = 1").withColumn("boss_archetype", F.lit("ranged")))
    scored = M.score(asked.withColumns({"run_id": F.lit("r"), "encounter_id": F.lit("e"),
                                        "reply": F.lit("{}")}), weights)
    found = {row["total_dashes"]: row for row in O.offers(scored).collect()}
    assert found[0]["prediction"] == "Loss" and found[99]["prediction"] == "Win"
    assert found[0]["confidence"] > 0.5 and found[99]["choices"][0]["debuffs"]
    assert found[1]["prediction"] is None and found[1]["dialogue"] == C.FALLBACK_DIALOGUE
