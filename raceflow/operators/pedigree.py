"""Lineage edges (entity, generation, position, ancestor) and their wide forms."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.session import cut_lineage, scratch_path, ship_package

# From this many pairs (entity, parent) on, lines are walked and not stored.
WALKED_PAIRS = 100_000
# Entities in a file of the walk, as a power of two; lines that a task holds at a time; entities of a task.
BLOCK_BITS = 20
MOST_LINES = 1 << 19
TASK_ENTITIES = 50_000
BATCH_ROWS = 1 << 16


def positions(edges: DataFrame, entity: str, generation: str, order: Sequence[str], out: str = "position") -> DataFrame:
    """1-based place of an ancestor within its generation. An entity has at most
    2^generation ancestors there, so the groups are small."""
    w = Window.partitionBy(entity, generation).orderBy(*order)
    return edges.withColumn(out, F.row_number().over(w))


def wide(edges: DataFrame, entity: str, generation: str, position: str, ancestor: str, generations: int = 5) -> DataFrame:
    """``g{generation}_p{position}_id`` columns, the first value per cell."""
    cells = [(g, p) for g in range(1, generations + 1) for p in range(1, 2 ** g + 1)]
    celled = edges.filter(F.col(generation) <= generations).withColumn(
        "_cell", F.concat_ws("_", F.col(generation), F.col(position)))
    out = celled.groupBy(entity).pivot("_cell", [f"{g}_{p}" for g, p in cells]).agg(F.min(ancestor))
    return out.toDF(entity, *[f"g{g}_p{p}_id" for g, p in cells])


def parents(edges: DataFrame, entity: str, generation: str, position: str, ancestor: str) -> DataFrame:
    """First-generation ancestors in order: sire, dam; one row per entity."""
    first = edges.filter(F.col(generation) == 1)
    return first.groupBy(entity).agg(F.max(F.when(F.col(position) == 1, F.col(ancestor))).alias("sire_id"),
                                     F.max(F.when(F.col(position) == 2, F.col(ancestor))).alias("dam_id"))


def dams_sire(edges: DataFrame, entity: str, generation: str, position: str, ancestor: str) -> DataFrame:
    """Third of the four grandparents: the dam's sire."""
    return edges.filter((F.col(generation) == 2) & (F.col(position) == 3)).select(
        entity, F.col(ancestor).alias("damsire_id"))


def depth_profile(edges: DataFrame, entity: str, generation: str) -> DataFrame:
    """Per generation: rows, entities, mean ancestors, share of entities with a full set."""
    per = edges.groupBy(entity, generation).agg(F.count(F.lit(1)).alias("_n"))
    full = (F.col("_n") == F.pow(F.lit(2), F.col(generation))).cast("int")
    return per.groupBy(generation).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("entities"),
                                       F.avg("_n").alias("mean_ancestors"), F.avg(full).alias("complete"))


def newest_per_ancestor(edges: DataFrame, entity: str, generation: str, ancestor: str, year: str,
                        tie: Sequence[str]) -> DataFrame:
    """One row per (entity, generation, ancestor): the latest birth year, unknown years last."""
    w = Window.partitionBy(entity, generation, ancestor).orderBy(F.desc_nulls_last(year), *tie)
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def ancestors(parentage: DataFrame, entity: str, parent: str, depth: int = 32, hot=None) -> DataFrame:
    """All ancestors up to ``depth`` generations: (entity, ancestor, distance, paths, share).

    ``paths`` counts the lines of descent of that length, ``share`` is the blood they bring
    (half per generation). Each round joins the lines of the greatest length so far with all
    known ones, which doubles the length: 2 to the power k generations take k rounds. Rows with a null
    on either side are left out, a repeated row counts as a further line. An entity among its own
    ancestors within ``depth`` raises an error, after log2 of the circle's length in rounds.

    From WALKED_PAIRS pairs on, the lines, of which there are hundreds for each pair, are neither stored nor shuffled:
    only the pairs are, and tasks walk up from their entities when the result is read (``_walked``).
    """
    one = (parentage.select(F.col(entity).alias("entity"), F.col(parent).alias("ancestor")).dropna()
           .groupBy("entity", "ancestor").agg(F.count(F.lit(1)).cast("double").alias("paths")))
    stored = [cut_lineage(one.withColumn("distance", F.lit(1)))]  # each round's lines, which are longer than all before
    if stored[0].count() >= WALKED_PAIRS:
        return _walked(stored[0], entity, parent, depth)
    length = 1
    while True:
        known = reduce(DataFrame.unionByName, stored)
        circle = stored[-1].filter("entity = ancestor").select("entity").distinct().limit(5).collect()
        if circle:
            raise _own_ancestors(parent, circle)
        tips = stored[-1].filter(F.col("distance") == length)
        if length >= depth or tips.isEmpty():
            break
        further = _continued(tips, known.filter(F.col("distance") <= depth - length), hot)
        stored.append(cut_lineage(further.groupBy("entity", "ancestor", "distance").agg(F.sum("paths").alias("paths"))))
        length *= 2
    return _with_share(known.filter(F.col("distance") <= depth), entity)


def _with_share(lines: DataFrame, entity: str) -> DataFrame:
    return lines.select(F.col("entity").alias(entity), F.col("ancestor"), "distance", "paths",
                        (F.col("paths") * F.pow(F.lit(0.5), F.col("distance"))).alias("share"))


def _own_ancestors(parent: str, circle) -> ValueError:
    return ValueError(f"{parent}: own ancestors: {sorted(str(r[0]) for r in circle)}")


def _continued(tips: DataFrame, known: DataFrame, hot) -> DataFrame:
    """Lines that go on from the last ancestor of ``tips``. The lines of hot ancestors (famous
    sires) are broadcast while small, the rest is a shuffle join that AQE splits where skewed."""
    on = known.select(F.col("entity").alias("_at"), F.col("ancestor").alias("_to"), F.col("distance").alias("_d"),
                      F.col("paths").alias("_n"))
    if hot is None:
        hot = skew.hot_keys(tips, ["ancestor"])
    cold, warm = skew.split_hot(tips, ["ancestor"], hot)
    parts = [] if cold is None else [(cold, on)]
    if warm is not None:
        few = cut_lineage(skew.split_hot(on, ["_at"], hot)[1])
        small = few.count() <= skew.BROADCAST_BYTES // skew.row_bytes(few)
        parts.append((warm, F.broadcast(few) if small else few))
    joined = [rows.join(lines, rows["ancestor"] == lines["_at"]).select(
        "entity", F.col("_to").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"),
        (F.col("paths") * F.col("_n")).alias("paths")) for rows, lines in parts]
    return reduce(DataFrame.unionByName, joined)


# ---- walking up -----------------------------------------------------------------------------

def _walked(pairs: DataFrame, entity: str, parent: str, depth: int) -> DataFrame:
    """All lines of the stored ``pairs`` (entity, ancestor, paths), made as they are read.

    Everyone gets a number; the names and the numbers of the parents lie in files by blocks of numbers, which the
    tasks map into memory. A task walks up from a batch of entities, a generation at a time, and adds up the paths
    that meet. What it holds is bounded by MOST_LINES, or by the ancestors of one entity if they are more.
    """
    spark = pairs.sparkSession
    ship_package(spark)
    kinds = [pairs.schema[c].dataType for c in ("entity", "ancestor")]
    names = pairs.select(F.col("entity").alias("name")).union(pairs.select("ancestor")).distinct()
    names, many = _counted(names)
    child = names.select(F.col("name").alias("entity"), F.col("id").alias("child"))
    above = names.select(F.col("name").alias("ancestor"), F.col("id").alias("parent"))
    edges = cut_lineage(pairs.select("entity", "ancestor", "paths").join(child, "entity").join(above, "ancestor").select("child", "parent", "paths"))
    folder = scratch_path(spark, "lines")
    spark.createDataFrame([], "id long").write.parquet(folder)  # makes the folder, wherever it is
    _stored(names, folder, _write_names)
    _stored(edges.withColumnRenamed("child", "id"), folder, _write_parents)

    circle = _walk(_inner(edges), folder, many, depth, names.schema["name"].dataType, circles=True).select("entity").distinct().limit(5).collect()
    if circle:
        raise _own_ancestors(parent, circle)
    tasks = max(-(-many // TASK_ENTITIES), spark.sparkContext.defaultParallelism)
    lines = _walk(spark.range(0, many, 1, tasks), folder, many, depth, names.schema["name"].dataType)
    return _with_share(lines.withColumns({c: F.col(c).cast(kind) for c, kind in zip(("entity", "ancestor"), kinds)}), entity)


def _counted(names: DataFrame) -> tuple[DataFrame, int]:
    """The stored names with numbers from 0 on without a gap, and how many they are."""
    stored = cut_lineage(names.withColumn("id", F.monotonically_increasing_id()))
    sizes = dict(stored.groupBy(F.shiftright("id", 33)).count().collect())  # a row per task that wrote
    before, many = {}, 0
    for part in sorted(sizes):
        before[part] = many - (part << 33)
        many += sizes[part]
    shift = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return stored.withColumn("id", F.col("id") + shift[F.shiftright("id", 33)]), many


def _inner(edges: DataFrame) -> DataFrame:
    """Numbers of the entities that may be their own ancestors: those left after taking away entities that are
    nobody's parent, again and again while that takes away a quarter of what is left."""
    left = edges.select("child", "parent")
    n, least = left.count(), edges.count() // 20
    while n > least:
        fewer = cut_lineage(left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi"))
        n, before = fewer.count(), n
        left = fewer
        if n > before * 3 // 4:
            break
    return left.select(F.col("child").alias("id")).distinct()


def _walk(ids: DataFrame, folder: str, many: int, depth: int, kind, circles: bool = False) -> DataFrame:
    def run(batches):
        if folder not in _open:
            _open.clear()
            _open[folder] = _Parents(folder, many)
        known = _open[folder]
        for batch in batches:
            start = np.asarray(batch.column(0))
            for src, node, paths, distance in known.lines(start, depth):
                if circles:
                    own = start[src] == node
                    src, node, paths = src[own], node[own], paths[own]
                for i in range(0, len(src), BATCH_ROWS):
                    part = slice(i, i + BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays(
                        [known.names(start[src[part]]), known.names(node[part]), pa.array(np.full(len(src[part]), distance, np.int32)),
                         pa.array(paths[part])], ["entity", "ancestor", "distance", "paths"])

    return ids.mapInArrow(run, f"entity {kind.simpleString()}, ancestor {kind.simpleString()}, distance int, paths double")


def _stored(rows: DataFrame, folder: str, write) -> None:
    def run(table: pa.Table) -> pa.Table:
        return write(table, folder)

    rows.withColumn("block", F.shiftright("id", BLOCK_BITS)).groupBy("block").applyInArrow(run, "block long").count()


def _write(folder: str, name: str, table: pa.Table) -> None:
    """One file of one batch; written under another name first, so that a retried task does no harm."""
    store, root = files.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    part = f"{root}/part-{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out, pa.ipc.new_file(out, table.schema) as sink:
        sink.write_batch(table.combine_chunks().to_batches(max_chunksize=None)[0])
    store.move(part, f"{root}/{name}")


def _write_names(table: pa.Table, folder: str) -> pa.Table:
    table = table.sort_by("id")
    block = table["block"][0].as_py()
    _write(folder, f"name-{block}", table.select(["name"]))
    return pa.table({"block": pa.array([block])})


def _write_parents(table: pa.Table, folder: str) -> pa.Table:
    """The parents and paths in the order of the block's entities, and where those of each begin."""
    table = table.sort_by("id")
    block = table["block"][0].as_py()
    ids = np.arange((1 << BLOCK_BITS) + 1) + (block << BLOCK_BITS)
    _write(folder, f"first-{block}", pa.table({"first": np.searchsorted(table["id"].to_numpy(), ids)}))
    _write(folder, f"above-{block}", table.select(["parent", "paths"]))
    return pa.table({"block": pa.array([block])})


def _by_block(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, places of its ids)."""
    blocks = ids >> BLOCK_BITS
    if len(ids) and blocks.max() < 1 << 16:
        blocks = blocks.astype(np.uint16)  # sorted by digits
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
    for at in np.split(order, cuts) if len(ids) else ():
        yield int(ids[at[0]] >> BLOCK_BITS), at


class _Parents:
    """The mapped files of a walk. A folder that is not mounted is copied to a temporary one."""

    def __init__(self, folder: str, many: int):
        store, root = files.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.many, self.copy, self.found = many, None, {}
        if not isinstance(store, files.LocalFileSystem):
            self.copy = tempfile.TemporaryDirectory()
            files.copy_files(root, self.copy.name, source_filesystem=store)
            root = self.copy.name
        for file in os.listdir(root):
            kind, _, block = file.partition("-")
            if kind in ("name", "first", "above") and block.isdigit():
                self.found[kind, int(block)] = pa.ipc.open_file(pa.memory_map(f"{root}/{file}")).get_batch(0).columns

    def names(self, ids: np.ndarray) -> pa.Array:
        parts = list(_by_block(ids))
        if not parts:
            return self.found["name", 0][0][:0]
        low = [pa.array(ids[at] & ((1 << BLOCK_BITS) - 1)) for _, at in parts]
        taken = [self.found["name", block][0].take(x) for (block, _), x in zip(parts, low)]
        if len(taken) == 1:
            return taken[0]
        back = np.empty(len(ids), np.int64)
        back[np.concatenate([at for _, at in parts])] = np.arange(len(ids))
        return pa.concat_arrays(taken).take(pa.array(back))

    def lines(self, start: np.ndarray, depth: int):
        """(place in ``start``, ancestor, paths, distance) of all lines, a generation of some entities at a time."""
        yield from self._further(np.arange(len(start)), start, np.ones(len(start)), 0, depth)

    def _further(self, src, node, paths, distance: int, depth: int):
        while len(node) and distance < depth:
            if len(node) > MOST_LINES and src[0] != src[-1]:
                middle = src[len(src) // 2]
                cut = np.searchsorted(src, middle) or np.searchsorted(src, middle, "right")
                for part in (slice(0, cut), slice(cut, None)):
                    yield from self._further(src[part], node[part], paths[part], distance, depth)
                return
            src, node, paths = self._up(src, node, paths)
            distance += 1
            if len(node):
                yield src, node, paths, distance

    def _up(self, src, node, paths):
        """One generation further, sorted by place and ancestor, the paths that meet added up."""
        made = [(src[:0], node[:0], paths[:0])]
        for block, at in _by_block(node):
            if ("first", block) not in self.found:
                continue
            first, = (np.asarray(x) for x in self.found["first", block])
            parent, times = (np.asarray(x) for x in self.found["above", block])
            low = node[at] & ((1 << BLOCK_BITS) - 1)
            begin, many = first[low], first[low + 1] - first[low]
            rows = np.repeat(at, many)
            place = np.arange(len(rows)) + np.repeat(begin - (np.cumsum(many) - many), many)
            made.append((src[rows], parent[place], paths[rows] * times[place]))
        src, node, paths = (np.concatenate(x) for x in zip(*made))
        key = src * self.many + node
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        return (*np.divmod(key[first], self.many), np.add.reduceat(paths[order], first) if len(key) else paths)


_open: dict[str, _Parents] = {}
