import random
import re
from collections import Counter

import numpy as np
import pytest

from compare import compare, connect
from raceflow.llm import phrases as P
from raceflow.llm.catalog import QUERIES, SQL
from raceflow.registry import Entry


def brute(rows, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) from plain counters."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang, low = lang if lang is not None else "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i:i + k])] += 1
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    gone = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * found[lang, p[i:i + k]]:
                    gone.add((lang, p[i:i + k]))
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s)
            for lang, rows in sorted(out.items()) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]


def mined(df, **how):
    return sorted(tuple(r) for r in P.mine(df, **how).collect())


def prose(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünter", "die", "漢字"]
    marks = [" "] * 8 + ["  ", "\t", ". ", ", ", "\n", "!", " ; ", "\x0b", "\xa0"]
    rows = []
    for i in range(n):
        parts = []
        while len(parts) < 120:
            parts += ["alpha", " ", "beta", " ", "gamma", " ", "delta", " "] if draw.random() < 0.05 else [draw.choice(words[:draw.randint(2, 33)]), draw.choice(marks)]
        rows.append((i, "".join(parts).upper() if i % 5 == 0 else "".join(parts), draw.choice(["en", "de", None])))
    return rows


@pytest.mark.parametrize("burst,held", [(P.BURST, P.HELD), (4, 60)])
def test_matches_plain_counters(spark, make_docs, monkeypatch, burst, held):
    monkeypatch.setattr(P, "PART", 50)  # first words are cut into parts
    rows = prose(120, 5)
    want = brute([r[1:] for r in rows], least=8, top=150)
    got = mined(make_docs(rows), least=8, top=150, burst=burst, held=held)
    assert got == sorted(want) and len({r[0] for r in got}) == 3
    assert any(len(r[2].split()) == 4 for r in got)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert mined(docs) == sorted(brute([(r["text"], r["lang"]) for r in docs.collect()]))
    problem, rows = compare(spark, connect(sf), Entry("op12", QUERIES["op12_hat_trie_phrases"], SQL["op12_hat_trie_phrases"], ""), sf)
    assert problem == "" and rows > 0


def test_trie_counts_bursts_and_spills():
    draw, trie, want, got = random.Random(1), P.Trie(2, burst=5, held=100), Counter(), Counter()
    spilled, deepest = 0, 0

    def depth(box):
        return 1 + max(map(depth, box.values()), default=0) if isinstance(box, P.Node) else 0

    def take(runs):
        for lang, ids, counts in runs:
            assert ids.tolist() == sorted(ids.tolist())
            for (a, b), n in zip(ids.tolist(), counts.tolist()):
                got[lang, a, b] += n
            yield lang

    for _ in range(300):
        lang = draw.randint(0, 1)
        phrases = sorted({(draw.choice([7, 7 << 56, 9 << 40, 2**64 - 1]), draw.randint(0, 99)) for _ in range(9)})
        trie.add(lang, [np.array(x, np.uint64) for x in zip(*phrases)], np.full(len(phrases), 2))
        for a, b in phrases:
            want[lang, a, b] += 2
        deepest = max(deepest, *(depth(root) for root in trie.roots.values()))
        if trie.total > 100:
            spilled += len(list(take(trie.spill(50))))
            assert trie.total <= 50
    list(take(trie.spill(0)))
    assert got == want and spilled and deepest == 16 and trie.total == 0 and not any(trie.roots.values())


def test_words_that_share_an_id_are_told_apart(spark, make_docs, monkeypatch):
    salted = P.W.salted
    monkeypatch.setattr(P.W, "salted", lambda h, kind: np.zeros_like(h) if kind == 0 else salted(h, kind))
    batch = P.pa.RecordBatch.from_arrays([P.pa.array(["a b", "a"]), P.pa.array(["en", None])], ["text", "lang"])
    clash = [r for b in P._vocabulary([batch], 0) for r in b.to_pylist()]
    assert {r["id"] for r in clash} == {0}
    assert len({r["id"] for b in P._vocabulary([batch], 1) for r in b.to_pylist()}) == 2


def test_awkward(awkward, nothing):
    rows = [(r["text"], r["lang"]) for r in awkward.collect()]
    assert mined(awkward) == sorted(brute(rows))
    assert mined(nothing) == [] and P.mine(nothing).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert mined(awkward, least=1, top=20) == sorted(brute(rows, least=1, top=20))
