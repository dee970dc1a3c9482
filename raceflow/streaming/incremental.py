"""Resumable processing: take a batch, keep what is new, replace what changed.

The sources are batch tables, so nothing here keeps streaming state; each function
can be handed to ``foreachBatch`` of a query that picks up new files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow.operators.keys import resolve_errors, upsert, work_list
from raceflow.session import cut_lineage, scratch_path

LOG = "batch_id long, version long, depth int, prefix long, rows long, bytes long, live boolean"
LEAF_BYTES = 1 << 30
TASK_BYTES = 16 << 20  # leaves smaller than this share a task
BROADCAST_CELLS = 1 << 20
HIDDEN = ["_hash", "_bytes"]


def row_bytes(df: DataFrame) -> Column:
    """Size of a row: the bytes of its texts, 8 for every other column, the JSON text of nested ones."""
    sizes = []
    for f in df.schema:
        kind = f.dataType.typeName()
        nested = kind in ("array", "map", "struct", "variant")
        held = F.to_json(F.struct(f.name)) if nested else F.col(f.name)
        sizes.append(F.coalesce(F.octet_length(held), F.lit(0)) if nested or kind in ("string", "binary") else F.lit(8))
    return sum(sizes, F.lit(0)).cast("long")


@contextmanager
def listed_by_slices(spark: SparkSession) -> Iterator[None]:
    """Folders named to a reader are listed by a few tasks a core, not by a task each."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def low_bits(value: Column, bits: int | Column) -> Column:
    """The last ``bits`` (at most 62) bits of a long."""
    count = F.lit(bits) if isinstance(bits, int) else bits
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), count) - 1)


class VersionedTable:
    """A Parquet table in leaves that split as they grow (extendible hashing).

    A leaf (depth, prefix) holds the rows whose key hash ends in the ``depth`` bits of ``prefix``. A batch
    rewrites the leaves that its keys fall into, each in one file, as a new version (a task writes several
    if they are small), and then adds one row per leaf to the commit log; the newest rows of the log are the directory. A leaf whose
    bytes and the batch's would pass ``limit`` is written as 2, 4, 8 … leaves of about half the
    limit instead, and its own log row ends it: keys are unique, so hashes spread evenly and no
    leaf grows apart. Leaves that a batch does not touch are neither read nor written.

    A job that dies before its log rows, also in the middle of a split, leaves the table as it
    was; a table opened again goes on where the log ends, and a batch in the log is not applied
    twice. ``parts`` is the least number of leaves of a new table (rounded up to a power of two).
    The directory on the driver has a row per leaf, some twice the table's bytes over ``limit``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 16, limit: int = LEAF_BYTES):
        self.spark, self.root, self.keys, self.limit = spark, path.rstrip("/"), list(keys), limit
        self.depth = (parts - 1).bit_length()

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.root}/log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def directory(self) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(depth, prefix) → (version, rows, bytes) of every live leaf."""
        newest = self.log().filter("depth >= 0").groupBy("depth", "prefix").agg(
            F.max(F.struct("version", "rows", "bytes", "live")).alias("n")).filter("n.live")
        return {(r["depth"], r["prefix"]): (r["n"]["version"], r["n"]["rows"], r["n"]["bytes"]) for r in newest.collect()}

    def _read(self, leaves: dict[tuple[int, int], tuple[int, int, int]]) -> DataFrame | None:
        paths = [f"{self.root}/data/version={v}/leaf={d}_{p}" for (d, p), (v, rows, _) in leaves.items() if rows]
        with listed_by_slices(self.spark):
            return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The current rows; None before the first batch."""
        found = self._read(self.directory())
        return found.drop(*HIDDEN) if found is not None else None

    def _cells(self, leaves: dict[tuple[int, int], tuple]) -> tuple[DataFrame, int]:
        """(cell, then a column for each number of the value) for all last bits of the deepest leaf, and how many bits."""
        most = max(d for d, _ in leaves)
        rows = [(d, p, *value) for (d, p), value in leaves.items()]
        names = ["depth", "prefix"] + [f"_x{i}" for i in range(len(rows[0]) - 2)]
        table = self.spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
        cells = table.withColumn("_cell", F.explode(F.expr(f"sequence(prefix, {(1 << most) - 1}L, shiftleft(1L, CAST(depth AS INT)))")))
        return (F.broadcast(cells) if 1 << most <= BROADCAST_CELLS else cells), most

    def _placed(self, rows: DataFrame, leaves: dict[tuple[int, int], tuple]) -> DataFrame:
        """``rows`` with the depth, prefix and numbers of their leaf."""
        cells, bits = self._cells(leaves)
        return rows.withColumn("_cell", low_bits(F.col("_hash"), bits)).join(cells, "_cell").drop("_cell")

    def _depth_for(self, depth: int, size: int) -> int:
        """The depth at which a leaf of ``size`` bytes makes leaves of some half of the limit."""
        if size <= self.limit:
            return depth
        return min(62, depth + math.ceil(math.log2(2 * size / self.limit)))

    def _leaves_a_task(self, leaves: int) -> int:
        """At most ``TASK_BYTES`` of them, and few enough to keep every core busy."""
        return max(1, min(TASK_BYTES // self.limit, leaves // (4 * self.spark.sparkContext.defaultParallelism)))

    def merge(self, batch: DataFrame, batch_id: int, order: Sequence[str] = ()) -> bool:
        """Upsert ``batch``, last row per key; False if the log has the batch already."""
        if not self.log().filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        held = self.directory()
        version = max((v for v, _, _ in held.values()), default=0) + 1
        leaves = held or {(self.depth, p): (0, 0, 0) for p in range(1 << self.depth)}
        fresh = cut_lineage(batch.withColumns({"_hash": F.xxhash64(*self.keys), "_bytes": row_bytes(batch)}))
        grown = self._placed(fresh.select("_hash", "_bytes"), {leaf: () for leaf in leaves}).groupBy("depth", "prefix").agg(
            F.sum("_bytes").alias("bytes")).collect()  # a row per leaf
        touched = {(r["depth"], r["prefix"]): self._depth_for(r["depth"], leaves[r["depth"], r["prefix"]][2] + r["bytes"]) for r in grown}
        log = self._write(fresh, {leaf: leaves[leaf] for leaf in touched}, touched, version, order) if touched else []
        new = [(batch_id, version, *row) for row in log] or [(batch_id, 0, -1, -1, 0, 0, False)]  # an empty batch is noted too
        if not held:  # the leaves that nothing fell into are live too
            new += [(batch_id, version, d, p, 0, 0, True) for d, p in leaves if touched and (d, p) not in touched]
        self.spark.createDataFrame(new, LOG).coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return True

    def _write(self, fresh: DataFrame, old: dict, touched: dict[tuple[int, int], int], version: int, order: Sequence[str]) -> list[tuple]:
        """Writes the touched leaves, split to their new depths; (depth, prefix, rows, bytes, live) of all that changed."""
        before = self._read(old)
        merged = upsert(before if before is not None else fresh.limit(0), fresh, self.keys, order)
        first, children = {}, []
        for (d, p), deep in touched.items():
            first[d, p] = (deep, len(children))
            children += [(deep, p + (i << d)) for i in range(1 << (deep - d))]
        placed = self._placed(merged, first)  # _x0: the new depth, _x1: the task of the first child
        depth, target = F.col("depth").cast("int"), F.col("_x0").cast("int")
        child = F.call_function("shiftright", low_bits(F.col("_hash"), target), depth)
        leaf = F.concat_ws("_", target.cast("string"), low_bits(F.col("_hash"), target).cast("string"))
        placed = placed.withColumns({"leaf": leaf, "_task": (F.col("_x1") + child).cast("int")}).drop("depth", "prefix", "_x0", "_x1")
        place = f"{self.root}/data/version={version}"
        share = self._leaves_a_task(len(children))
        placed = placed.withColumn("_task", F.expr(f"CAST(_task DIV {share} AS INT)"))
        placed.repartitionById(-(-len(children) // share), "_task").drop("_task").write.mode("overwrite").partitionBy("leaf").parquet(place)
        with listed_by_slices(self.spark):
            stored = self.spark.read.schema("leaf string, _bytes long").parquet(place)
        written = stored.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes")).collect()  # a row per leaf
        sizes = {r["leaf"]: (r["rows"], r["bytes"]) for r in written}
        log = [(d, p, *sizes.get(f"{d}_{p}", (0, 0)), True) for d, p in children]
        return log + [(d, p, 0, 0, False) for (d, p), deep in touched.items() if deep > d]


def upsert_batch(table: VersionedTable, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function merging each batch into the table, last row per key."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id, order)
    return merge


def resume(inputs: DataFrame, output: DataFrame, errors: DataFrame, key: str,
           process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], keys: Sequence[str]):
    """Process only what is missing or failed before: (new output, remaining errors)."""
    good, bad = process(work_list(inputs, output, errors, key))
    merged = upsert(output, good, keys)
    return merged, resolve_errors(errors, merged, key).unionByName(bad, allowMissingColumns=True)


def new_table(spark: SparkSession, name: str, keys: Sequence[str], parts: int = 16, limit: int = LEAF_BYTES) -> VersionedTable:
    return VersionedTable(spark, scratch_path(spark, name), keys, parts, limit)
