"""The versioned table: leaves that split, restarts in the middle of a split, tasks within the limit."""

import random

import pytest
from pyspark.sql import functions as F

from raceflow.session import scratch_path
from raceflow.streaming.incremental import VersionedTable, row_bytes

LIMIT = 2_000


def table(spark, place, parts=1):
    return VersionedTable(spark, place, ["k"], parts, LIMIT)


def batch(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, note string")


def state(t):
    return {r["k"]: (r["v"], r["note"]) for r in t.read().collect()}


def test_leaves_split_and_stay_within_the_limit(spark):
    draw, place, want, seen = random.Random(2), scratch_path(spark, "grow"), {}, []
    for i in range(6):
        rows = {f"k{draw.randint(0, 400)}": (i, "x" * draw.randint(0, 9)) for _ in range(40 * (i + 1))}
        assert table(spark, place).merge(batch(spark, [(k, *v) for k, v in rows.items()]), i)
        want |= rows
        leaves = table(spark, place).directory()
        assert sum(rows for _, rows, _ in leaves.values()) == len(want)
        assert all(size <= LIMIT for _, _, size in leaves.values())
        assert sum(2.0 ** -d for d, _ in leaves) == pytest.approx(1)  # every hash has one leaf
        seen.append(len(leaves))
    assert state(table(spark, place)) == want
    assert seen[0] < seen[-1] and max(d for d, _ in table(spark, place).directory()) >= 3


def test_only_touched_leaves_are_written(spark):
    place = scratch_path(spark, "touched")
    table(spark, place, 8).merge(batch(spark, [(f"k{i}", i, "") for i in range(60)]), 0)
    before = table(spark, place).directory()
    table(spark, place).merge(batch(spark, [("k7", -1, "")]), 1)
    after = table(spark, place).directory()
    assert len(before) == 8 and sum(after[x] != before[x] for x in before) == 1
    assert state(table(spark, place))["k7"] == (-1, "") and len(state(table(spark, place))) == 60


def test_a_death_in_the_middle_of_a_split(spark, monkeypatch):
    place = scratch_path(spark, "death")
    table(spark, place).merge(batch(spark, [(f"k{i}", 0, "") for i in range(50)]), 0)
    before, rows = table(spark, place).directory(), [(f"k{i}", 1, "y" * 20) for i in range(25, 400)]
    real = VersionedTable._write

    def dies(self, *args):
        real(self, *args)  # the children are written, the log is not
        raise RuntimeError("lost")

    monkeypatch.setattr(VersionedTable, "_write", dies)
    with pytest.raises(RuntimeError):
        table(spark, place).merge(batch(spark, rows), 1)
    monkeypatch.undo()
    assert table(spark, place).directory() == before and len(state(table(spark, place))) == 50
    assert table(spark, place).merge(batch(spark, rows), 1) and not table(spark, place).merge(batch(spark, rows), 1)
    got = state(table(spark, place))
    assert len(got) == 400 and got["k30"] == (1, "y" * 20) and got["k3"] == (0, "")
    assert len(table(spark, place).directory()) > len(before)


def test_new_columns_nulls_and_empty_batches(spark):
    place = scratch_path(spark, "odd")
    t = table(spark, place)
    assert t.read() is None and t.merge(batch(spark, []), 0) and t.read() is None
    t.merge(batch(spark, [("a", 1, None), (None, 2, "null key")]), 1)
    t.merge(spark.createDataFrame([("a", 5, [1, 2]), ("b", 6, None)], "k string, v int, list array<int>"), 2)
    got = {r["k"]: r.asDict() for r in t.read().collect()}
    assert set(got) == {"a", None, "b"} and got["a"]["list"] == [1, 2] and got[None]["note"] == "null key"
    sizes = batch(spark, [("ab", 1, None)]).select(row_bytes(batch(spark, [("ab", 1, None)]))).first()[0]
    assert sizes == 2 + 8


def test_a_batch_is_written_in_several_tasks(spark):
    place = scratch_path(spark, "tasks")
    table(spark, place).merge(batch(spark, [(f"k{i}", i, "z" * 30) for i in range(600)]), 0)
    files = spark.read.parquet(f"{place}/data/version=1").groupBy(F.col("_metadata.file_path")).agg(F.sum("_bytes").alias("b")).collect()
    assert len(files) >= 8 and all(r["b"] <= LIMIT for r in files)


def test_small_leaves_share_tasks_and_listings(spark, monkeypatch):
    name, dealt, listed = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], []
    frame, reader = type(spark.range(1)), type(spark.read)
    deal, parquet, usual = frame.repartitionById, reader.parquet, spark.conf.get(name)

    def seen(self, parts, *cols):
        dealt.append(parts)
        return deal(self, parts, *cols)

    def looked(self, *paths, **kw):
        listed.append(int(spark.conf.get(name)))
        return parquet(self, *paths, **kw)

    monkeypatch.setattr(frame, "repartitionById", seen)
    monkeypatch.setattr(reader, "parquet", looked)
    place, cores = scratch_path(spark, "small"), spark.sparkContext.defaultParallelism
    rows = [(f"k{i}", i, "") for i in range(2000)]
    t = VersionedTable(spark, place, ["k"], 16 * cores, 1 << 18)
    t.merge(batch(spark, rows), 0)
    leaves = t.directory()
    assert dealt == [4 * cores] and len(leaves) == 16 * cores
    files = t._read(leaves).inputFiles()
    assert len(files) == sum(n > 0 for _, n, _ in leaves.values())  # a file a leaf, as before
    assert state(t) == {k: (v, note) for k, v, note in rows}
    assert min(listed) == 4 * cores and spark.conf.get(name) == usual
    assert VersionedTable(spark, place, ["k"])._leaves_a_task(1000) == 1  # leaves of 1 GB have a task each
