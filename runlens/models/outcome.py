"""Scaled logistic regression per archetype, kept as a small table of weights.

The weights table makes scoring a join and a column expression for all archetypes at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import constants as C
from runlens.operators.training import infer_features, labelled

#: Newton steps of a fit, and the gain in loss per row below which it is done.
MAX_STEPS = 25
MIN_PROGRESS = 1e-12

WEIGHTS = T.StructType([
    T.StructField("boss_archetype", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("sd", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()),
])


def figures(rows: DataFrame, features: Sequence[str]) -> dict[str, tuple[int, list, list]]:
    """Rows, means and sample deviations per archetype, by one aggregate."""
    found = rows.groupBy("boss_archetype").agg(
        F.count("*").alias("n"), F.array(*[F.avg(name) for name in features]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_samp(name), F.lit(0.0)) for name in features]).alias("sd"))
    out = {}
    for row in found.collect():
        # What is left of equal values by rounding is no spread.
        sd = [b if b > 1e-12 * abs(a) else 0.0 for a, b in zip(row["mean"], row["sd"])]
        out[row["boss_archetype"]] = row["n"], row["mean"], sd
    return out


def _by_archetype(values: dict[str, Sequence[float]], at: int) -> Column:
    """One number per archetype, as a constant expression."""
    found = F.lit(0.0)
    for archetype, numbers in sorted(values.items()):
        found = F.when(F.col("boss_archetype") == archetype, float(numbers[at])).otherwise(found)
    return found


def newton_sums(rows: DataFrame, scaled: Sequence[str], weights: dict[str, np.ndarray],
                ) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Gram matrix of every archetype, by one aggregate over all rows.

    `scaled` are the standardised columns; the last weight is the intercept.
    """
    d = len(scaled) + 1
    margin = _by_archetype(weights, d - 1)
    for at, name in enumerate(scaled):
        margin = margin + _by_archetype(weights, at) * F.col(name)
    # The margin is a column of its own, so that it is computed once per row.
    rows = rows.withColumn("margin", margin).withColumn(
        "p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))))
    columns = [*[F.col(name) for name in scaled], F.lit(1.0)]
    rest, spread = F.col("outcome") - F.col("p"), F.col("p") * (1 - F.col("p"))
    # log(1 + e^m) - y m, without overflow.
    loss = F.greatest(F.col("margin"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("margin"))) - (
        F.col("outcome") * F.col("margin"))
    pairs = [(a, b) for a in range(d) for b in range(a + 1)]
    found = rows.groupBy("boss_archetype").agg(
        F.sum(loss).alias("loss"), *[F.sum(rest * x).alias(f"g{at}") for at, x in enumerate(columns)],
        *[F.sum(spread * columns[a] * columns[b]).alias(f"h{a}_{b}") for a, b in pairs])
    out = {}
    for row in found.collect():
        gram = np.zeros((d, d))
        for a, b in pairs:
            gram[a, b] = gram[b, a] = row[f"h{a}_{b}"]
        out[row["boss_archetype"]] = (
            row["loss"], np.array([row[f"g{at}"] for at in range(d)]), gram)
    return out


def _step(gradient: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Newton step; directions in which the rows do not differ are left alone."""
    # Columns of zeros stay out: the solver would leave rounding in their weights.
    seen = np.flatnonzero(np.diag(gram))
    step = np.zeros(len(gradient))
    step[seen] = np.linalg.lstsq(gram[np.ix_(seen, seen)], gradient[seen], rcond=1e-10)[0]
    return step


def train(training: DataFrame, archetypes: Sequence[str] = C.ARCHETYPES,
          features: Sequence[str] | None = None, steps: int = MAX_STEPS,
          progress: float = MIN_PROGRESS) -> DataFrame:
    """Weights of one model per archetype: a row per feature, a handful of rows in all.

    All archetypes are fitted together by Newton's method: a step is one aggregate over all rows,
    whose sums of fixed size come to the driver. A step that does not lower the loss of an
    archetype is halved. Labels that a feature tells apart wholly have no finite optimum; their
    weights grow by a bounded amount a step. An archetype without rows has no weights.
    """
    features = list(features or infer_features(training))
    scaled = [f"z{at}" for at in range(len(features))]
    rows = labelled(training).filter(F.col("boss_archetype").isin(*archetypes)).select(
        "boss_archetype", *[F.col(name).cast("double").alias(name) for name in features],
        F.col("outcome").cast("double")).dropna(subset=features)
    # Every step reads these few columns again.
    rows.persist()
    try:
        scale = figures(rows, features)
        means = {key: value[1] for key, value in scale.items()}
        inverse = {key: [1 / sd if sd else 0.0 for sd in value[2]] for key, value in scale.items()}
        z = rows.select("boss_archetype", "outcome", *[
            ((F.col(name) - _by_archetype(means, at)) * _by_archetype(inverse, at)).alias(scaled[at])
            for at, name in enumerate(features)])
        weights = {key: np.zeros(len(features) + 1) for key in scale}
        sums = newton_sums(z, scaled, weights) if scale else {}
        moves = {key: _step(*sums[key][1:]) for key in sums}
        open_ = set(moves)
        for _ in range(steps):
            if not open_:
                break
            tried = {key: weights[key] + moves[key] for key in open_}
            new = newton_sums(z, scaled, {**weights, **tried})
            for key in list(open_):
                gain = sums[key][0] - new[key][0]
                if gain < 0:
                    moves[key] = moves[key] / 2
                    if np.abs(moves[key]).max() < 1e-12:
                        open_.discard(key)
                    continue
                weights[key], sums[key] = tried[key], new[key]
                moves[key] = _step(*new[key][1:])
                if gain <= progress * scale[key][0]:
                    open_.discard(key)
    finally:
        rows.unpersist()
    return training.sparkSession.createDataFrame([
        (key, name, float(weights[key][at]), float(scale[key][1][at]), float(scale[key][2][at]),
         float(weights[key][-1]))
        for key in archetypes if key in scale for at, name in enumerate(features)], WEIGHTS)


def feature_weights(weights: DataFrame) -> DataFrame:
    """Learned weights without the intercept."""
    return weights.select("boss_archetype", "feature", "weight")


def top_features(weights: DataFrame, k: int = 2, by: str = "boss_archetype") -> DataFrame:
    """The k features of largest absolute weight per model, missing ones filled with `default`.

    Rank and padding come from one aggregate per model over its few features.
    """
    order = Window.partitionBy(by).orderBy(F.desc(F.abs("weight")), F.col("feature"))
    ranked = weights.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= k)
    return ranked.groupBy(by).agg(*[
        F.coalesce(F.max(F.when(F.col("slot") == slot, F.col("feature"))),
                   F.lit(C.DEFAULT_FEATURE)).alias(f"feature_{slot}")
        for slot in range(1, k + 1)])


def score(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Add `prediction`, `confidence` and the two leading features of the row's archetype.

    An archetype without a model leaves them null: the row then falls back.
    """
    names = [row[0] for row in weights.select("feature").distinct().collect()]
    per_model = weights.groupBy("boss_archetype").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct(
            "weight", "mean", "sd")))).alias("_terms"), F.first("intercept").alias("_intercept"))
    per_model = per_model.join(top_features(weights), "boss_archetype")
    scored = rows.join(per_model, "boss_archetype", "left")
    margin = F.col("_intercept")
    for name in names:
        term = F.col("_terms")[name]
        scaled = F.when(term["sd"] != 0, (F.col(name) - term["mean"]) / term["sd"]).otherwise(
            F.lit(0.0))
        margin = margin + F.when(term.isNotNull(), term["weight"] * scaled).otherwise(F.lit(0.0))
    win = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    return with_prediction(scored.withColumn("win_probability", win)).withColumnsRenamed(
        {"feature_1": "primary_feature", "feature_2": "secondary_feature"}).drop(
            "_terms", "_intercept")


def with_prediction(scored: DataFrame) -> DataFrame:
    """Class and its probability from `win_probability`."""
    win = F.col("win_probability")
    return scored.withColumns({
        "prediction": F.when(win > 0.5, "Win").when(win.isNotNull(), "Loss"),
        "confidence": F.when(win > 0.5, win).when(win.isNotNull(), 1 - win),
    })
