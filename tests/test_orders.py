"""Leading orders of a race, against full enumeration."""

import random
from itertools import permutations

import pytest

from raceflow.operators import outcomes


def brute(field, top, length):
    """(runners, probability) of the best orders: probabilities to 12 digits, then the runners' ranks."""
    ranked = sorted((r for r in field if r[1] and r[1] > 0), key=lambda r: (-r[1], r[0]))
    found = []
    for order in permutations(range(len(ranked)), length):
        chance, left = ranked[order[0]][1], 1.0
        for a, b in zip(order, order[1:]):
            left -= ranked[a][1]
            chance *= ranked[b][1] / left
        found.append((-round(chance, 12), order))
    return [([ranked[i][0] for i in order], -p) for p, order in sorted(found)[:top]]


@pytest.mark.parametrize("top,length", [(20, 3), (7, 2), (4, 1)])
def test_matches_full_enumeration(spark, top, length):
    draw, races = random.Random(top), {}
    for race in range(12):
        n = [1, 2, 3, 4, 9, 18, 30][race % 7]
        weights = [draw.choice([1, 1, 2, 3, draw.random() * 9]) for _ in range(n)]
        races[race] = [(k, w / sum(weights)) for k, w in enumerate(draw.sample(weights, n))]
    races[50] = [(k, 2.0 ** -(k % 9) / 200) for k in range(300)]  # a race of many runners, with ties
    races[51] = [(1, 0.5), (2, None), (3, 0.0), (4, 0.3), (5, 0.2)]
    rows = [(race, k, p) for race, field in races.items() for k, p in field]
    df = spark.createDataFrame(rows, "race_id int, runner int, win double")
    got = {}
    for r in outcomes.top_orders(df, top, length).orderBy("race_id", "place").collect():
        got.setdefault(r["race_id"], []).append((list(r["runners"]), pytest.approx(r["probability"], abs=1e-11)))
    for race, field in races.items():
        field = field if race != 50 else sorted(field, key=lambda r: (-r[1], r[0]))[:top + length + 3]
        assert brute(field, top, length) == got.get(race, [])


def test_plan_joins_nothing_and_limits_first(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "race_id int, runner int, win double")
    plan = outcomes.top_orders(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan
    assert outcomes.top_orders(df.limit(0)).collect() == []
    assert len(outcomes.leading_orders(20, 3)) < 300 and max(map(max, outcomes.leading_orders(20, 3))) == 22
