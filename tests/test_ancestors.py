"""Ancestors of any depth by doubling, against walking every line."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from raceflow import skew
from raceflow.operators import pedigree

SCHEMA = "horse int, parent int"


def walked(edges, depth):
    of, out = {}, Counter()
    for child, parent in edges:
        of.setdefault(child, []).append(parent)
    for start in of:
        lines = Counter({start: 1})
        for distance in range(1, depth + 1):
            lines = sum((Counter({p: n * k for p, k in Counter(of[a]).items()}) for a, n in lines.items() if a in of), Counter())
            for a, n in lines.items():
                out[start, a, distance] += n
    return out


def found(df):
    rows = df.collect()
    assert all(r.share == r.paths * 0.5 ** r.distance for r in rows)
    return {(r.horse, r.ancestor, r.distance): r.paths for r in rows}


@pytest.mark.parametrize("hot", [[], [(0,), (1,)], skew.EVERYTHING])
@pytest.mark.parametrize("depth", [1, 5, 32])
def test_matches_walk(spark, hot, depth, monkeypatch):
    if depth == 5:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    draw, edges = random.Random(depth), []
    for child in range(1, 60):
        edges += [(child, 0), (child, draw.randrange(child))]  # one sire for all
    edges += [(59, 3), (59, 3)]
    df = spark.createDataFrame([*edges, (7, None), (None, 7)], SCHEMA)
    assert found(pedigree.ancestors(df, "horse", "parent", depth, hot=hot)) == walked(edges, depth)


def test_thirty_generations_in_five_rounds(spark, monkeypatch):
    rounds = []
    inner = pedigree._continued
    monkeypatch.setattr(pedigree, "_continued", lambda *a: rounds.append(1) or inner(*a))
    df = spark.createDataFrame([(i, i + 1) for i in range(30)], SCHEMA)
    out = found(pedigree.ancestors(df, "horse", "parent", hot=[]))
    assert len(rounds) == 5 and out[0, 30, 30] == 1 and len(out) == 30 * 31 // 2


@pytest.mark.parametrize("circle", [[(1, 1)], [(1, 2), (2, 3), (3, 1), (9, 1)]])
def test_own_ancestor_is_an_error(spark, circle):
    with pytest.raises(ValueError, match="own ancestors"):
        pedigree.ancestors(spark.createDataFrame(circle, SCHEMA), "horse", "parent")


def test_empty(spark):
    assert pedigree.ancestors(spark.createDataFrame([], SCHEMA), "horse", "parent").collect() == []


@pytest.fixture
def walking(monkeypatch):
    monkeypatch.setattr(pedigree, "WALKED_PAIRS", 1)
    monkeypatch.setattr(pedigree, "_continued", None)


@pytest.mark.parametrize("depth", [1, 5, 32])
def test_lines_are_walked_and_not_stored(spark, walking, monkeypatch, depth):
    written, store = [], pedigree.cut_lineage

    def counted(df):
        out = store(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(pedigree, "cut_lineage", counted)
    draw, edges = random.Random(depth), []
    for child in range(1, 60):
        edges += [(child, 0), (child, draw.randrange(child))]
    edges += [(59, 3), (59, 3), (2 ** 30, 59)]
    df = spark.createDataFrame([*edges, (7, None), (None, 7)], SCHEMA)
    out = pedigree.ancestors(df, "horse", "parent", depth)
    assert out.schema == spark.createDataFrame([], "horse int, ancestor int, distance int, paths double, share double").schema
    assert found(out) == walked(edges, depth) and max(written) <= len(edges)


def test_names_are_walked(spark, walking):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("é", "a")]
    df = spark.createDataFrame(edges, "horse string, parent string")
    assert found(pedigree.ancestors(df, "horse", "parent")) == walked(edges, 32)


def test_walk_in_small_blocks_and_parts(monkeypatch, tmp_path):
    """As the tasks do it, in this process: files of four entities, two lines at a time."""
    monkeypatch.setattr(pedigree, "BLOCK_BITS", 2)
    monkeypatch.setattr(pedigree, "MOST_LINES", 2)
    draw = random.Random(5)
    edges = [(child, draw.randrange(child)) for child in range(1, 30) for _ in range(2)]
    pairs = Counter(edges)
    for block in range(8):
        ids = range(4 * block, min(4 * block + 4, 30))
        own = [(c, p, n) for (c, p), n in pairs.items() if c in ids]
        pedigree._write_names(pa.table({"block": [block] * len(ids), "id": ids, "name": [f"n{i}" for i in ids]}), str(tmp_path))
        c, p, n = zip(*own)
        pedigree._write_parents(pa.table({"block": [block] * len(own), "id": c, "parent": p, "paths": [float(x) for x in n]}), str(tmp_path))
    known, start, got = pedigree._Parents(str(tmp_path), 30), np.arange(30), {}
    for src, node, paths, distance in known.lines(start, 32):
        names = known.names(node).to_pylist()
        assert names == [f"n{i}" for i in node]
        got |= {(int(start[s]), int(a), distance): n for s, a, n in zip(src, node, paths)}
    assert got == walked(edges, 32)


@pytest.mark.parametrize("circle", [[(1, 1)], [(1, 2), (2, 3), (3, 1), (9, 1)]])
def test_own_ancestor_is_an_error_for_the_walk(spark, walking, circle):
    df = spark.createDataFrame(circle, SCHEMA)
    with pytest.raises(ValueError, match="own ancestors"):
        pedigree.ancestors(df, "horse", "parent")
    if len(circle) > 1:
        assert pedigree.ancestors(df, "horse", "parent", depth=2).count() == 8
