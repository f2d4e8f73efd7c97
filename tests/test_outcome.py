"""Fits of all archetypes at once, against numpy."""

import numpy as np
import pytest

from runlens.models import outcome as M

SCHEMA = "boss_archetype string, u double, v double, w double, outcome int"


def tight_fit(x, y, steps=200):
    """Weights and intercept of a logistic regression on standardised columns."""
    sd = x.std(axis=0, ddof=1)
    z = np.column_stack([(x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ weights))
        gram = (z * (p * (1 - p))[:, None]).T @ z
        weights = weights + 0.5 * np.linalg.lstsq(gram, z.T @ (y - p), rcond=None)[0]
    return weights


@pytest.fixture(scope="module")
def rows():
    random, out = np.random.default_rng(1), []
    for archetype, n, slope in (("melee", 400, 0.5), ("ranged", 60, -1.0), ("final", 200, 3.0)):
        x = random.normal([5, -2, 7], [3, 0.1, 0], (n, 3))  # the third column is constant
        chance = 1 / (1 + np.exp(-slope * (x[:, 0] - 5) / 3 - 0.3))
        out += [(archetype, *map(float, row), int(random.random() < p))
                for row, p in zip(x, chance)]
    return out


def test_weights_equal_a_tight_fit(spark, rows):
    found = {(r.boss_archetype, r.feature): r for r in M.train(
        spark.createDataFrame(rows, SCHEMA), features=["u", "v", "w"]).collect()}
    assert len(found) == 9
    for archetype in ("melee", "ranged", "final"):
        own = np.array([row[1:] for row in rows if row[0] == archetype], float)
        wanted = tight_fit(own[:, :3], own[:, 3])
        got = [found[archetype, name] for name in "uvw"]
        assert np.allclose([r.weight for r in got], wanted[:3], atol=1e-6)
        assert all(abs(r.intercept - wanted[3]) < 1e-6 for r in got)
        assert np.allclose([r.mean for r in got], own[:, :3].mean(axis=0))
        assert got[2].sd == 0 and got[2].weight == 0


def test_labels_told_apart_and_one_label_only(spark):
    table = [("melee", float(x), 0.0, 0.0, int(x > 10)) for x in range(20)]
    table += [("ranged", float(x), 0.0, 0.0, 1) for x in range(20)]
    table += [("other", 1.0, 1.0, 1.0, 1), ("melee", None, 0.0, 0.0, 1),
              ("melee", 1.0, 0.0, 0.0, None)]
    weights = M.train(spark.createDataFrame(table, SCHEMA), features=["u", "v", "w"])
    kept = weights.collect()
    assert {r.boss_archetype for r in kept} == {"melee", "ranged"}
    assert all(np.isfinite([r.weight, r.intercept]).all() for r in kept)
    asked = spark.createDataFrame([r for r in table if r[1] is not None], SCHEMA).filter(
        "boss_archetype != 'other' and outcome is not null")
    wrong = M.score(asked, weights).filter("(win_probability > 0.5) != (outcome = 1)")
    assert wrong.count() == 0


def test_one_aggregate_a_step_for_all_archetypes(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed(
        {"u": "z0", "v": "z1", "w": "z2"})
    sums = M.newton_sums(table, ["z0", "z1", "z2"], {k: np.zeros(4) for k in (
        "melee", "ranged", "final")})
    own = np.array([row[1:] for row in rows if row[0] == "ranged"], float)
    x = np.column_stack([own[:, :3], np.ones(len(own))])
    loss, gradient, gram = sums["ranged"]
    assert np.isclose(loss, len(own) * np.log(2))
    assert np.allclose(gradient, x.T @ (own[:, 3] - 0.5)) and np.allclose(gram, x.T @ x / 4)


def test_no_rows_give_no_weights(spark):
    assert M.train(spark.createDataFrame([], SCHEMA), features=["u", "v", "w"]).count() == 0
