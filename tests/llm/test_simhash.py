import random

import numpy as np
import pytest
import xxhash

from raceflow.llm import simhash as S
from raceflow.session import cut_lineage


def plain_fingerprint(text):
    """One shingle and one bit at a time."""
    words, at = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            if at:
                words.append(at)
            at = ""
        else:
            at += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, ids, radius=4):
    """Smallest id reachable, comparing every two fingerprints."""
    label, fps = list(ids), np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= radius) for f in fps]
    moved = True
    while moved:
        moved = False
        for who in near:
            low = min(label[i] for i in who)
            for i in who:
                moved |= label[i] != low
                label[i] = low
    return label


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    got = {r["doc_id"]: r for r in S.components(docs).collect()}
    assert [got[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    label = brute(fps, ids)
    assert [got[i]["component_id"] for i in ids] == label
    assert len(set(label)) < len(set(fps)) < len(ids)


def clustered(n, seed):
    """Random fingerprints, many of them 0 to 6 bits from another one, most in one tight cloud."""
    draw = random.Random(seed)
    fps = [0, 2**64 - 1, 0b1111, 0b11111 << 59]
    while len(fps) < n:
        base = draw.choice(fps) if draw.random() < 0.7 else draw.getrandbits(64)
        for b in draw.sample(range(64), draw.randint(0, 6)):
            base ^= 1 << b
        fps.append(base)
    return sorted(set(fps))


@pytest.mark.parametrize("radius,group", [(4, 1 << 21), (4, 30_000), (4, 50), (2, 500), (0, 1)])
def test_links_tie_what_is_near(spark, radius, group):
    fps = clustered(120 if group == 50 else 500, radius + group)
    rows = cut_lineage(spark.createDataFrame([(S._signed(f),) for f in fps], "fp long"))
    links = [(r["u"] % 2**64, r["v"] % 2**64) for r in S.links(rows, len(fps), radius, group).collect()]
    assert all((u ^ v).bit_count() <= radius for u, v in links)
    at = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in range(60):
        for u, v in links:
            label[at[u]] = label[at[v]] = min(label[at[u]], label[at[v]])
    assert label == brute(fps, range(len(fps)), radius)


def test_awkward(spark, awkward, nothing):
    rows = S.components(awkward).collect()
    assert len(rows) == awkward.count()
    texts = {(r["doc_id"], r["text"]) for r in awkward.collect()}
    want = sorted((d if d is not None else -1, f"{plain_fingerprint(t)}") for d, t in texts)
    got = {(r["doc_id"] if r["doc_id"] is not None else -1, f"{int(r['fingerprint'], 16)}") for r in rows}
    assert got == set(want)
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[None] is None and component[1] == component[2] == component[3] == 1
    assert component[9] == component[10] == 9 and component[8] == 8
    assert S.components(nothing).collect() == []
    assert S.components(nothing).columns == ["doc_id", "fingerprint", "component_id"]


def test_repeated_ids_are_labelled_by_their_own_text(make_docs):
    rows = [(5, "a b c d e f"), (5, "quite another text of some words"), (3, "a b c d e f"), (7, "quite another text of some words")]
    got = sorted((r["doc_id"], r["component_id"]) for r in S.components(make_docs(rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5)]


def test_a_hot_fingerprint(make_docs):
    rows = [(i, "the same few words every time") for i in range(400)] + [(1000 + i, f"word{i} other{i} next{i} last{i}") for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in S.components(make_docs(rows)).collect()}
    assert {got[i] for i in range(400)} == {0} and len(got) == 600
