import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from raceflow.llm import langid as L
from raceflow.llm import words as W


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"(?:[a-z]|[^\x00-\x7f])+", low)


def brute(labelled):
    """The definition on strings, without limits on the model's size."""
    langs = sorted({x for x, _ in labelled})
    counts = {k: {x: Counter() for x in langs} for k in (0, *L.ORDERS)}
    for lang, text in labelled:
        for w in split(text):
            counts[0][lang][w] += 1
            for n in L.ORDERS:
                counts[n][lang].update(w[i:i + n] for i in range(len(w) - n + 1))
    known = {k: set().union(*c.values()) for k, c in counts.items()}

    def weight(k, x, lang):
        c = counts[k][lang]
        return math.log((c[x] + L.SMOOTH) / (sum(c.values()) + L.SMOOTH * len(known[k])))

    def guess(text):
        votes = dict.fromkeys(langs, 0.0)
        found = split(text or "")
        if not any(ch.isalpha() for ch in text or ""):
            return L.UNKNOWN, 0.0
        for w in found:
            for k in (0, *L.ORDERS):
                parts = [w] if k == 0 else [w[i:i + k] for i in range(len(w) - k + 1)]
                parts = [x for x in parts if x in known[k]]
                if parts:
                    for lang in langs:
                        votes[lang] += sum(weight(k, x, lang) for x in parts) / len(parts)
                    break
        best = max(langs, key=lambda x: votes[x])
        return best, 1 / sum(math.exp(votes[x] - votes[best]) for x in langs)

    return guess


def test_matches_definition(make_docs):
    learnt = [("en", "the cat sat on the mat, The End"), ("de", "der Hund läuft über die Straße"), ("fr", "le chat était là"),
              ("fr", "été à la plage")]
    model = L.learn(make_docs([(i, t, x) for i, (x, t) in enumerate(learnt)]))
    guess = brute(learnt)
    texts = ["the mat", "catastrophe", "übermorgen", "läuf", "plages d'été", "xyz", "日本語", "12 — 34", "", None, "ß", "THE cat läuft",
             "q", "straßenbahn über", "a " * 3000 + "là"]
    rows = {r["doc_id"]: r for r in L.predict(make_docs(list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        want = guess(t)
        assert rows[i]["lang_pred"] == want[0], t
        assert rows[i]["score"] == pytest.approx(want[1], abs=1e-4)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.98


def test_size_limits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.learn(docs, per_lang=50, max_words=500, max_grams=300)
    assert len(model.keys[0]) <= 500 and all(len(model.keys[n]) <= 300 for n in L.ORDERS)


def test_awkward(awkward, nothing):
    rows = L.identify(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert all(0 <= r["score"] <= 1 for r in rows) and by_id[8]["lang_pred"] in ("en", "de", "fr")
    assert L.identify(nothing).collect() == []
    assert {r["lang_pred"] for r in L.predict(awkward, L.learn(nothing)).collect()} == {"und"}
    kept = L.accepted(awkward)
    assert kept.columns == awkward.columns and not {1, 2, 3, 7} & {r["doc_id"] for r in kept.collect()}


def test_memory_does_not_follow_the_batch():
    draw = random.Random(1)
    texts = pa.array([" ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(300)) for _ in range(2000)])  # 4 MB, unknown words
    model = L.Model(["en"], {k: np.zeros(1, np.uint64) for k in (L.WORD, *L.ORDERS)}, {k: np.zeros((1, 1), np.float32) for k in (L.WORD, *L.ORDERS)})
    labelled = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), texts], ["lang", "text"])
    for work in (lambda: L.guess(texts, model), lambda: sum(b.num_rows for b in L._counted([labelled], ["en"]))):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 << 20, peak


def test_model_reaches_the_driver_in_columns(make_docs, monkeypatch):
    """Not as 140,000 rows of Python objects."""
    docs = make_docs([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der Hund lief", "de"), ("the dog", "en")])])
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(type(docs), name, few(getattr(type(docs), name)))
    model = L.learn(docs)
    assert model.languages == ["de", "en"]
    the = W.Letters(*W.texts_of(pa.array(["the"]))).words()
    at = np.searchsorted(model.keys[L.WORD], the)
    assert model.keys[L.WORD][at] == the and model.weights[L.WORD][1][at] > model.weights[L.WORD][0][at]
    assert all((np.diff(k.astype(object)) > 0).all() for k in model.keys.values())


def few(method):
    def run(self):
        rows = method(self)
        assert len(rows) <= 6, "more than a row for each language or kind"
        return rows
    return run
