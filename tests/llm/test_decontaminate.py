import pytest

from compare import compare, connect
from raceflow.llm import decontaminate as D
from raceflow.llm.catalog import QUERIES, SQL
from raceflow.registry import Entry


def found(docs, items, spark):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in D.search(docs, benchmark).select("doc_id", "item_id", "hits", "n_item").collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, size):
    sf = f"/root/testdata/{size}"
    name = "op10_containment_search"
    problem, rows = compare(spark, connect(sf), Entry(name, QUERIES[name], SQL[name], ""), sf)
    assert problem == "" and rows > 0


def test_sketch_cannot_miss_small_items():
    for n in range(1, 65):
        assert D.sketch_size(n) > (1 - D.LEAST) * n or D.sketch_size(n) == n
    assert D.sketch_size(10_000) <= 14


def test_pieces_far_apart_and_long_documents(spark, make_docs):
    words = [f"w{i}" for i in range(44)]  # 40 shingles
    filler = " ".join(f"f{i}" for i in range(9000))
    two = " ".join(words[:23]) + " " + filler + " " + " ".join(words[18:])  # all but one shingle
    docs = make_docs([(1, two), (2, " ".join(words[:36])), (3, " ".join(words[:35])), (4, filler)])
    got = found(docs, [(9, " ".join(words).upper())], spark)
    assert got == [(1, 9, 40, 40), (2, 9, 32, 40)]


def test_blocks_do_not_matter(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    def results():
        return sorted(D.search(docs, items).collect()), sorted(r["doc_id"] for r in D.clean(docs, items).collect())
    whole = results()
    blocks = [(len(b.value.ids), more) for b, more in D.blocks_of(items, block_shingles=200)]
    assert len(blocks) > 3 and sum(n for n, _ in blocks) == items.count()
    assert [more for _, more in blocks] == [True] * (len(blocks) - 1) + [False]
    monkeypatch.setattr(D, "BLOCK_SHINGLES", 200)
    assert whole[0] and results() == whole


def test_awkward(spark, awkward, nothing):
    items = [(1, None), (2, ""), (3, "one"), (4, "two  THREE"), (5, "same words in the same order"),
             (5, "same words in the same order"), (None, "the cat sat on the mat"), (7, "a")]
    got = sorted(
        ((r[0] if r[0] is not None else -1, r[1] if r[1] is not None else -1) for r in D.search(
            awkward, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()))
    assert got == sorted([(4, 3), (5, 3), (5, 4), (8, -1), (9, 5), (9, 5), (10, 5), (10, 5), (10, 5), (10, 5), (-1, 7), (12, 7)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.search(awkward, none).collect() == [] and D.search(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    kept = D.clean(awkward, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7]
