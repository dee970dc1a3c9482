"""As-of lookups against a plain scan, with and without hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from raceflow.operators import timeline


def plain(left, right, tolerance, strict):
    out = []
    for i, k, t in left:
        found = [(s, x) for r, s, x in right if k is not None and t is not None and r == k and s is not None
                 and (s < t if strict else s <= t)]
        best = max(found, key=lambda f: (f[0], f[1] is not None, f[1] or 0)) if found else None
        if best and tolerance is not None and best[0] + tolerance < t:
            best = None
        out.append((i, k, t, *(best or (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [[], [(1,), (2,)], "everything"])
@pytest.mark.parametrize("tolerance,strict", [(None, False), (5, True), (3, False)])
def test_matches_a_scan(spark, hot, tolerance, strict):
    draw = random.Random(3)
    keys = [1, 1, 1, 2, 3, 4, None]
    left = [(i, draw.choice(keys), draw.choice([None, *range(60)])) for i in range(200)]
    right = [(draw.choice(keys[:5] + [None]), draw.choice([None, *range(0, 60, 2)]), draw.choice([None, 1, 2, 3])) for _ in range(90)]
    a = spark.createDataFrame(left, "seen_by int, k int, t int")
    b = spark.createDataFrame(right, "k int, seen int, x int")
    got = timeline.as_of(a, b, ["k"], "t", "seen", ["x"], tolerance=None if tolerance is None else F.lit(tolerance), strict=strict, hot=hot)
    assert got.columns == ["seen_by", "k", "t", "seen", "x"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(left, right, tolerance, strict)


def test_empty_sides_and_equal_left_rows(spark):
    a = spark.createDataFrame([(1, 5), (1, 5), (None, 2)], "k int, t int")
    b = spark.createDataFrame([(1, 4, "x", 2), (1, 4, "a", 9)], "k int, seen int, x string, version int")
    rows = [tuple(r) for r in timeline.as_of(a, b, ["k"], "t", "seen", ["x"], tie=["version"]).collect()]
    assert sorted(rows, key=str) == [(1, 5, 4, "a"), (1, 5, 4, "a"), (None, 2, None, None)]
    assert timeline.as_of(a, b.limit(0), ["k"], "t", "seen", ["x"]).filter("x IS NULL").count() == 3
    assert timeline.as_of(a.limit(0), b, ["k"], "t", "seen", ["x"]).collect() == []
