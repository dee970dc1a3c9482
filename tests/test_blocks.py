"""Block manifests: digests by row range, trees over them, changes named without reading data again."""

import pytest
from pyspark.sql import functions as F

from raceflow.session import scratch_path
from raceflow.sources import files


def stored(spark, rows, name="copy"):
    """One file of (id, text) rows in the given order; the path of its tree."""
    data, tree = f"{scratch_path(spark, name)}/data", scratch_path(spark, "tree")
    spark.createDataFrame(rows, "id int, text string").coalesce(1).write.parquet(data)
    files.hash_tree(files.block_manifest(spark, data, block_rows=4, by_folder=True), levels=3, fanout=2).write.parquet(tree)
    return spark.read.parquet(tree)


ROWS = [(i, f"t{i}") for i in range(50)]


@pytest.mark.parametrize("change,want", [
    (lambda r: r, []),
    (lambda r: [(i, t) if i != 21 else (21, "other") for i, t in r], [(5, "changed")]),
    (lambda r: [(i, t) if i != 21 else (21, None) for i, t in r], [(5, "changed")]),
    (lambda r: [r[1], r[0], *r[2:]], [(0, "changed")]),  # order counts
    (lambda r: r[:44], [(11, "removed"), (12, "removed")]),
    (lambda r: [*r, (50, "t"), (51, "t"), (52, "t")], [(12, "changed"), (13, "added")]),
    (lambda r: r[:8] + r[4:8] + r[12:], [(2, "changed")]),  # a block repeated in place of another
])
def test_changes_are_named(spark, change, want):
    old, new = stored(spark, ROWS), stored(spark, change(ROWS))
    got = files.changed_blocks(old, new, levels=3, fanout=2).orderBy("block").collect()
    assert [(r["block"], r["state"]) for r in got] == want


def test_the_tree_shrinks_and_counts_all_rows(spark):
    tree = stored(spark, ROWS)
    sizes = [r["n"] for r in tree.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy("level").collect()]
    assert sizes == [13, 7, 4, 2]
    assert {r["rows"] for r in tree.groupBy("level").agg(F.sum("rows").alias("rows")).collect()} == {50}


def test_a_file_is_read_in_several_tasks(spark):
    """A file of several row groups is hashed by as many tasks; the digests do not depend on that."""
    data = f"{scratch_path(spark, 'large')}/data"
    spark.range(0, 400_000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.option(
        "parquet.block.size", str(1 << 20)).parquet(data)
    digests = []
    for most in ("128m", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            blocks = files.block_manifest(spark, data, block_rows=10_000)
            digests.append((spark.read.parquet(data).rdd.getNumPartitions(), {(r["path"], r["block"]): r["digest"] for r in blocks.collect()}))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert digests[0][1] == digests[1][1] and len(digests[0][1]) == 40 and digests[1][0] > 8
