"""The scorer of whole finishing orders against sums written out race by race."""

import math
import random

import numpy as np
import pytest

from raceflow import skew
from raceflow.plans import listwise

SCHEMA = "race_id int, place int, horse_id int, a double, b double, c double"
TRUE = (1.2, -0.7)


def races(n=150, seed=3):
    """Orders drawn by the model itself, with races of 1 to 30 runners."""
    draw, rows = random.Random(seed), []
    for race in range(n):
        field = [(k, draw.gauss(0, 1), draw.gauss(0, 1)) for k in range(draw.choice([1, 2, 5, 9, 14, 30]))]
        # the order of exp(score) / exponential draws is an order of successive choices
        placed = sorted(field, key=lambda f: -(TRUE[0] * f[1] + TRUE[1] * f[2] - math.log(draw.expovariate(1))))
        rows += [(race, p + 1, k, x, y, 4.0) for p, (k, x, y) in enumerate(placed)]
    return rows


def brute(rows, z, w):
    ll, g, h = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    fields = {}
    for r, x in sorted(zip(rows, z), key=lambda p: p[0][:2]):
        fields.setdefault(r[0], []).append(x)
    for field in fields.values():
        field = np.array(field)
        for i in range(len(field)):
            e = np.exp(field[i:] @ w)
            p = e / e.sum()
            mean = p @ field[i:]
            ll += math.log(p[0])
            g += field[i] - mean
            h += (field[i:] * p[:, None]).T @ field[i:] - np.outer(mean, mean)
    return ll, g, h


@pytest.mark.parametrize("hot", [[], skew.EVERYTHING, [(5,), (6,)], None])
def test_sums_match_brute_force(spark, hot):
    rows = races(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for w in ((0.0, 0.0), (0.8, -2.5), (40.0, 3.0)):
        got = listwise.likelihood_sums(df, "race_id", ["place", "horse_id"], ["a", "b"], w, hot)
        want = brute(rows, [r[3:5] for r in rows], np.array(w))
        for x, y in zip(got, want):
            np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-8)


def test_fit_finds_the_weights(spark):
    rows = races(400)
    df = spark.createDataFrame(rows, SCHEMA)
    model = listwise.fit(df, "race_id", ["place", "horse_id"], ["a", "b", "c"])
    raw = np.array(model.weights[:2]) / np.array(model.spreads[:2])
    assert np.abs(raw - TRUE).max() < 0.1 and model.weights[2] == 0.0 and model.steps < 10
    z = (np.array([r[3:5] for r in rows]) - model.means[:2]) / model.spreads[:2]
    ll, g, _ = brute(rows, z, np.array(model.weights[:2]))
    assert np.abs(g).max() < 1e-3 and abs(ll - model.log_likelihood) < 1e-6
    # a column given twice shares its weight instead of failing
    twice = listwise.fit(df.withColumn("d", df.a), "race_id", ["place", "horse_id"], ["a", "b", "d"])
    assert abs(twice.weights[0] + twice.weights[2] - model.weights[0]) < 1e-4


def test_awkward(spark):
    rows = races(30) + [(900, None, 1, 1.0, 1.0, 1.0), (901, 1, 1, None, None, None), (901, 2, 2, 1.0, None, 1.0)]
    model = listwise.fit(spark.createDataFrame(rows, SCHEMA), "race_id", ["place", "horse_id"], ["a", "b"])
    assert all(map(math.isfinite, model.weights))
    empty = spark.createDataFrame([], SCHEMA)
    assert listwise.fit(empty, "race_id", ["place", "horse_id"], ["a"]).weights == (0.0,)
    with pytest.raises(ValueError):
        listwise.fit(empty, "race_id", ["place"], [f"x{i}" for i in range(41)])


@pytest.mark.parametrize("hot", [[], skew.EVERYTHING])
def test_chances(spark, hot):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, math.log(3)), (2, 1, -900.0), (2, 2, -900.0), (3, 1, None), (1, 3, None)],
                               "race_id int, k int, score double")
    got = {(r.race_id, r.k): r.win_chance for r in listwise.chances(df, "race_id", "score", hot=hot).collect()}
    assert got[1, 1] == pytest.approx(0.25) and got[1, 2] == pytest.approx(0.75) and got[1, 3] == 0.0
    assert got[2, 1] == pytest.approx(0.5) and got[3, 1] is None
