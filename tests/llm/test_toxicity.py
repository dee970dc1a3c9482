import numpy as np

from raceflow.llm import toxicity as T
from raceflow.llm import words as W


def auc(pairs):
    pairs = sorted(pairs)
    ranks = {}
    values = [s for s, _ in pairs]
    for s in set(values):
        first = np.searchsorted(values, s, "left")
        ranks[s] = (first + np.searchsorted(values, s, "right") + 1) / 2
    bad = [ranks[s] for s, y in pairs if y]
    n, m = len(bad), len(pairs) - len(bad)
    return (sum(bad) - n * (n + 1) / 2) / (n * m)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc([(r["score"], r["toxic"]) for r in rows]) > 0.95
    flagged = [r for r in rows if r["predicted"]]
    right = sum(r["toxic"] for r in flagged)
    assert right / len(flagged) > 0.93 and right / sum(r["toxic"] for r in rows) > 0.8
    assert all(0 <= r["score"] <= 1 for r in rows)


def features(text, entries=("idiot",)):
    import pyarrow as pa
    h = np.sort(W.Letters(*W.texts_of(pa.array([" ".join(entries)]))).words())
    return dict(zip(T.FEATURES, T.dense(*W.texts_of(pa.array([text])), (h, np.full(len(h), 5.0)))[0]))


def test_features():
    f = features("You are an IDIOT! really")
    assert f["density"] == 0.2 and f["near_second"] == 0.2 and f["second"] == 0.2 and f["strongest"] == 5
    assert f["shouted"] == 0.2 and f["exclamation"] > 0 and f["hidden_hits"] == 0
    g = features("some id1ot wrote thiiiis")
    assert g["density"] == 0 and g["hidden_hits"] > 0 and g["obfuscated"] > 0 and g["stretched"] > 0
    assert not any(features("").values())


def test_awkward(spark, awkward, nothing):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 1), (8, 1, 0), (9, 1, None), (10, 0, 0), (12, 0, 1), (None, 1, 1), (99, 1, 1)], schema)
    for own in (labels, labels.limit(0), labels.filter("toxic = 0")):
        rows = T.score(awkward, own).collect()
        assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
        assert T.score(nothing, own).collect() == []
