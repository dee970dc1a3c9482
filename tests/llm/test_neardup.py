import random

import numpy as np
import pytest

from compare import compare, connect
from raceflow.llm import components
from raceflow.llm import neardup as N
from raceflow.llm.catalog import QUERIES, SQL
from raceflow.llm.components import connected
from raceflow.registry import Entry


def shingles(text):
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3)))


def brute(rows):
    """doc_id → smallest doc_id reachable, comparing all pairs."""
    label = {d: d for d, _ in rows}
    sets = [(d, shingles(t)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1:]
             if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def result(df):
    return {r["doc_id"]: r["component_id"] for r in N.components(df).collect()}


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op2_minhash_bayes"
    problem, rows = compare(spark, connect(sf), Entry(name, QUERIES[name], SQL[name], ""), sf)
    assert problem == "" and rows > 0


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 7)])
def test_chains_and_shared_passages(spark, make_docs, monkeypatch, seed, block):
    """Chains of small edits (links without a common centre) beside texts that share a long passage."""
    monkeypatch.setattr(N, "FAMILY_BLOCK", block)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for step in range(9):
            rows.append((rng.randrange(10**6), " ".join(words)))
            words = list(words)
            for _ in range(3):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    rows += [(rng.randrange(10**6), " ".join(passage + [f"u{rng.random()}" for _ in range(rng.randrange(8, 30))])) for _ in range(60)]
    base = [f"b{i}" for i in range(150)]
    for _ in range(60):  # copies of one text, most of them less than 0.8 alike
        words = list(base)
        for _ in range(rng.randrange(2, 6)):
            words[rng.randrange(150)] = f"m{rng.random()}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    rows = list(dict(rows).items())
    want = brute(rows)
    assert result(make_docs(rows)) == want
    assert len(set(want.values())) < len(rows) - 30


def test_thresholds():
    needed = N.least_matches()
    assert len(needed) == N.ROWS * N.BANDS // N.BATCH and needed == sorted(needed)
    rng = np.random.default_rng(0)
    drawn = rng.random((20_000, N.ROWS * N.BANDS)) < 0.8 + 0.2 / 256
    sums = drawn.cumsum(axis=1)[:, N.BATCH - 1::N.BATCH]
    assert (sums < np.array(needed)).any(axis=1).mean() < 1e-3
    assert needed[-1] > 0.55 * N.ROWS * N.BANDS


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 9), (7, 8), (8, 7), (6, 6), (20, 10), (20, 11), (20, 12)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 9: 2, 7: 7, 8: 7, 20: 10, 10: 10, 11: 10, 12: 10}
    line = [(i, i + 1) for i in range(200)]
    assert {r["component"] for r in connected(spark.createDataFrame(line, "u long, v long")).collect()} == {0}
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_components_spare_the_driver(spark):
    """A round deals its edges out four times (planned: seven, three of them reused), and its garbage is collected."""
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 2)], "u long, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = components._small_star(components._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") <= 7, plan
    full = collections(spark)
    connected(edges)
    assert collections(spark) > full


def test_awkward(awkward, nothing):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.components(awkward).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 5, True), (9, 5, 9, True),
            (10, 5, 9, False), (None, 5, None, True), (12, 1, 12, True)} <= rows
    assert N.components(awkward).count() == awkward.count()
    assert N.components(nothing).collect() == []
    kept = N.kept_documents(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 12]
