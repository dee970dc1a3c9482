import numpy as np
import pytest
from pyspark.sql import functions as F

from raceflow.llm import mixing as M
from raceflow.session import cut_lineage


def brute(p, tokens, goal, rounds=200_000):
    """Plain projected gradient in the tokens' metric, many small steps."""
    r, total = np.ones(len(p)), tokens.sum()
    for _ in range(rounds):
        gap = (r * tokens) @ p / total - goal
        if np.abs(gap).max() < 1e-7:
            break
        r = np.maximum(0, r - 0.9 * p @ gap)
    return r


@pytest.mark.parametrize("goal", [(0.85, 0.11, 0.04), (0.2, 0.3, 0.5)])
def test_matches_plain_gradient(spark, goal):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([2.0, 0.7, 0.4], 300)
    tokens = rng.integers(1, 400, 300)
    rows = [(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p))]
    members = cut_lineage(spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>"))
    got = np.array([r["rate"] for r in M.rates(members, goal, gap=1e-6, budget=0.9).orderBy("doc_id").collect()])
    want = brute(p, tokens, np.array(goal) * 0.9)
    assert (got >= 0).all()
    held = (got * tokens) @ p / tokens.sum()
    assert np.abs(held - np.array(goal) * 0.9).max() < 1e-4
    if (want > 0).all():  # nothing was cut off at 0: the fit nearest to rate 1 is unique
        assert got == pytest.approx(want, abs=1e-3)


def test_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = M.mix(docs, labels)
    assert rows.count() == docs.count()
    held = rows.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) / F.sum("tokens") for d in M.DOMAINS]).first()
    assert list(held) == pytest.approx([t * M.BUDGET for t in M.TARGETS], abs=2e-3)
    judged = rows.join(labels, "doc_id")
    good = judged.filter("quality = 1 AND toxic = 0").agg(F.avg((F.col("p_good") > 0.5).cast("int"))).first()[0]
    plain = judged.filter("quality = 0 AND toxic = 0").agg(F.avg((F.col("p_plain") > 0.5).cast("int"))).first()[0]
    assert good > 0.97 and plain > 0.9
    kept = M.drawn(docs, labels)
    assert kept.columns == docs.columns and kept.groupBy("doc_id").count().filter("count > 1").isEmpty()
    post = M.posteriors(docs, labels).join(kept.select("doc_id"), "doc_id")
    assert shares(post) == pytest.approx(M.TARGETS, abs=0.01)


def shares(members):
    return list(members.agg(*[F.sum(F.col("tokens") * F.get("p", d)) / F.sum("tokens") for d in range(3)]).first())


@pytest.mark.parametrize("good,targets", [(0.5, M.TARGETS), (0.76, M.TARGETS), (0.95, M.TARGETS), (0.95, (0.6, 0.3, 0.1))])
def test_realised_shares_meet_the_targets(spark, make_docs, monkeypatch, good, targets):
    """Corpora of several compositions, with soft posteriors and texts of 5 to 300 words."""
    rng = np.random.default_rng(int(100 * good))
    kinds = rng.choice(3, 1500, p=[good, (1 - good) * 0.7, (1 - good) * 0.3])
    p = np.array([rng.dirichlet(np.where(np.arange(3) == k, 12, 0.4)) for k in kinds])
    tokens = np.exp(rng.uniform(np.log(5), np.log(300), 1500)).astype(int)
    members = cut_lineage(spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p))],
                                                "doc_id long, tokens long, p array<double>"))
    monkeypatch.setattr(M, "posteriors", lambda docs, labels: members)
    docs = make_docs([(i, "x " * int(t)) for i, t in enumerate(tokens)])
    rated = M.chances(members, targets)
    rates = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    assert (0 <= rates).all() and (rates <= 1).all()
    supply = (tokens @ p) / tokens.sum() / np.array(targets)  # no draw without repeats can keep more than the scarcest domain allows
    assert 0.5 * min(1, supply.min()) < (rates @ tokens) / tokens.sum() <= min(1, supply.min()) + 0.01
    kept = M.drawn(docs, None, targets)
    assert shares(members.join(kept.select("doc_id"), "doc_id")) == pytest.approx(targets, abs=0.01)
    assert abs(kept.count() - rates.sum()) <= 4


def test_awkward(spark, awkward, nothing):
    some = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (8, 0, 1), (9, 1, 0), (10, 0, 0), (12, 1, None), (None, 1, 0), (77, 0, 1)],
                                 "doc_id long, quality int, toxic int")
    for labels in (some, some.limit(0), some.filter("doc_id = 4")):
        rows = M.mix(awkward, labels).collect()
        assert len(rows) == awkward.count()
        assert all(r["rate"] >= 0 and abs(r["p_good"] + r["p_plain"] + r["p_toxic"] - 1) < 1e-9 for r in rows)
        assert all(r["tokens"] == 0 and r["rate"] == 1 for r in rows if r["doc_id"] in (1, 2))
        kept = M.drawn(awkward, labels)
        assert kept.columns == awkward.columns
        assert kept.count() <= awkward.count()
    assert M.mix(nothing, some).collect() == [] and M.drawn(nothing, some).collect() == []
