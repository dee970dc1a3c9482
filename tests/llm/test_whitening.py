import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceflow.llm import whitening as T

VECTORS = "vec_id long, embedding array<float>, x long, many long, z string, w int, component int, n long"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "z", 3, 4, 5) for i, v in rows], VECTORS)


def brute(rows, weight="one"):
    """(n, eigenvalues, eigenvectors, distinct x, exact deviations) from exact fractions."""
    xs = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in rows]
    kinds = sorted(set(xs))
    w = [xs.count(k) if weight == "count" else 1 for k in kinds]
    n, dim = sum(w), len(kinds[0])
    sums = [sum(a * k[d] for a, k in zip(w, kinds)) for d in range(dim)]
    centred = [[n * k[d] - sums[d] for d in range(dim)] for k in kinds]
    cov = np.array([[float(Fraction(sum(a * c[i] * c[j] for a, c in zip(w, centred)), n ** 3)) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    return n, values[::-1], vectors[:, ::-1], dict(zip(kinds, np.array(centred, float) / n)), {
        k: sum(a * a for a in c) for k, c in zip(kinds, centred)}, xs


@pytest.mark.parametrize("weight", ["one", "count"])
def test_matches_exact_arithmetic(spark, weight):
    draw = np.random.default_rng(4)
    vectors = draw.normal(0, 1, (60, 6)) * [3, 2, 1.5, 1, 0.7, 0.4]
    rows = [(i, [float(np.float32(c)) for c in vectors[min(i, 59) if i < 60 else i % 3]]) for i in range(140)]
    n, values, axes, centred, exact, xs = brute(rows, weight)
    got = T.whiten(make(spark, rows), weight=weight, components=4).collect()
    assert len(got) == 140 * 4 and {r["n"] for r in got} == {n}
    sign = {}
    for r in got:
        c, x = r["component"] - 1, xs[r["vec_id"]]
        want = centred[x] @ axes[:, c] / math.sqrt(values[c])
        sign.setdefault(c, 1.0 if want * r["whitened"] > 0 else -1.0)
        assert r["whitened"] == pytest.approx(sign[c] * want, abs=1e-9)
        assert r["deviation"] == exact[x] and r["deviation_text"] is None
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_embeddings(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = T.whiten(vectors)
    assert rows.count() == 16 * vectors.count()
    xs = np.array([r["x"] for r in T.integers(vectors).collect()])
    fit = np.unique(xs, axis=0)
    first = rows.first()
    assert first["n"] == len(fit) and first["identity_error"] < 1e-4
    top = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    shares = {r["component"]: r["explained"] for r in rows.select("component", "explained").distinct().collect()}
    assert [shares[c + 1] for c in range(16)] == pytest.approx((top / top.sum())[:16].tolist(), rel=1e-9)


def test_rows_that_are_left_out_or_repeated(spark):
    whole = [(1, [0.5, 1.0, -2.0]), (2, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (None, [4.0, 1.0, 1.0]), (7, [0.25, 3.0, 9.0]), (8, [1.0, 1.0, 1.0])]
    bad = [(3, None), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [1.0, float("inf"), 2.0]), (9, [])]
    rows = T.whiten(make(spark, whole + bad)).collect()
    assert len(rows) == len(whole) * 3 and {r["n"] for r in rows} == {5}
    assert {r["vec_id"] for r in rows} == {1, 2, None, 7, 8}
    assert T.whiten(make(spark, bad)).collect() == [] and T.whiten(make(spark, [])).columns == T.whiten(make(spark, whole)).columns


def test_no_spread_and_different_lengths(spark):
    rows = T.whiten(make(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in rows)
    rows = T.whiten(make(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [2.0])])).collect()
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert got[(1, 2)] is None and abs(got[(1, 1)]) == pytest.approx(1) and got[(3, 1)] == pytest.approx(-got[(4, 1)])


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])]
    got = {r["vec_id"]: r for r in T.whiten(make(spark, rows)).filter("component = 1").collect()}
    assert got[1]["deviation"] is None and int(got[1]["deviation_text"]) > 1 << 63
    assert got[1]["whitened"] == pytest.approx(-got[2]["whitened"])
    n, _, _, _, exact, _ = brute([(1, [2.0 ** 56, 0.0]), (2, [-2.0 ** 56, 0.0]), (3, [0.0, 1.0])])
    assert sorted(int(r["deviation_text"] or r["deviation"]) for r in got.values()) == sorted(exact.values())


def test_a_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [float(i % 7), float(i % 11), i / 64]) for i in range(200)]
    got = T.whiten(make(spark, rows))
    assert got.count() == 1500 and got.groupBy("vec_id", "component").count().filter("count > 1").isEmpty()
    assert got.filter("vec_id < 1000 AND component = 1").agg(F.count_distinct("whitened")).first()[0] == 1
