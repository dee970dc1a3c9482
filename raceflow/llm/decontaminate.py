"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of distinct five-word shingles. An item's sketch
is its m smallest shingle hashes; m grows with the partition's size until the chance that
a document holding 80 % of the item has none of them is below ``miss``. Up to 64
shingles that chance is zero, because more than a fifth of the item is in the sketch.
Every shingle of every document is looked up in the sketches, whatever the document's
length; each hit is verified by counting the item's shingles in the whole document.

Items of fewer than five words are one shingle of their own length, sought among the
documents' sequences of that length. Null and empty items are found nowhere, null and empty documents hold
nothing. Repeated documents and items give their own rows. Only the columns named are
read. Items are searched in blocks of at most ``block_shingles`` shingles, so that what
is broadcast is bounded; results are written between blocks, and driver and workers
hold one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow.llm import words as W
from raceflow.session import cut_lineage

WORDS = 5
LEAST = 0.8
MISS = 1e-9
BLOCK_SHINGLES = 4_000_000
OUT = "item_id long, hits long, n_item long, containment double"


def sketch_size(shingles: int, miss: float = MISS) -> int:
    """Smallest hashes kept for items of up to ``shingles`` shingles (a partition's bound)."""
    certain = math.floor((1 - LEAST) * shingles + 1e-9) + 1
    return min(shingles, certain, math.ceil(math.log(miss) / math.log(1 - LEAST)))


def partition_bound(shingles: np.ndarray) -> np.ndarray:
    """The upper end of an item's size partition: the next power of two."""
    return 1 << np.ceil(np.log2(np.maximum(shingles, 1))).astype(int)


def _item_rows(batches):
    """(item_id, words, shingles) with the distinct sorted hashes as bytes."""
    for batch in batches:
        data, offsets = W.texts_of(batch.column(1))
        hashes, bounds = W.hashed_words(data, offsets)
        sets = [np.unique(W.shingles(hashes[a:b], WORDS)) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(bounds).astype(np.int64)),
             pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["item_id", "words", "n", "shingles"])


@dataclass
class Block:
    """Items side by side: their sets, and the sketch hashes of each sequence length."""
    ids: np.ndarray
    sets: list[np.ndarray]
    sketches: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length → keys, first, items

    @staticmethod
    def of(rows) -> Block:
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        bounds = partition_bound(np.array([len(s) for s in sets], int))
        by_length: dict[int, list] = {}
        for i, (r, s, bound) in enumerate(zip(rows, sets, bounds)):
            m = min(len(s), sketch_size(int(bound)))
            by_length.setdefault(min(r["words"], WORDS), []).append((s[:m], np.full(m, i)))
        sketches = {}
        for length, own in by_length.items():
            hashes, items = (np.concatenate(x) for x in zip(*own))
            order = np.argsort(hashes, kind="stable")
            keys, first = np.unique(hashes[order], return_index=True)
            sketches[length] = keys, np.append(first, len(order)), items[order]
        return Block(np.array([r["item_id"] for r in rows], object), sets, sketches)

    def found(self, data: np.ndarray, offsets: np.ndarray):
        """(row, item, hits) of the verified containments of a part's texts."""
        words, bounds = W.hashed_words(data, offsets)
        for length, (keys, first, items) in self.sketches.items():
            h, rows = W.shingle_rows(words, bounds, length)
            at, hit = W.place(keys, h)
            at, owner = at[hit], rows[hit]
            many = first[at + 1] - first[at]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs = np.unique(np.stack([np.repeat(owner, many), items[np.repeat(first[at], many) + step]], 1), axis=0)
            row, own = -1, None
            for r, i in pairs:
                if r != row:
                    lo, hi = np.searchsorted(rows, [r, r + 1])
                    row, own = r, np.unique(h[lo:hi])
                held = int(W.place(own, self.sets[i])[1].sum())
                if held >= LEAST * len(self.sets[i]) - 1e-9:
                    yield int(r), int(i), held


def blocks_of(benchmark: DataFrame, block_shingles: int | None = None) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark as broadcast blocks, each with whether more follow.

    One collect for each block, none larger than the bound allows; the driver holds one at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        _item_rows, "item_id long, words long, n long, shingles binary").filter("n > 0")
    items = cut_lineage(items.repartition(F.xxhash64("item_id", "shingles")))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = -(-total // (block_shingles or BLOCK_SHINGLES))
    part = F.pmod(F.xxhash64("shingles", "item_id"), F.lit(max(1, many)))
    for k in range(many):
        yield benchmark.sparkSession.sparkContext.broadcast(Block.of(items.filter(part == k).collect())), k + 1 < many


def settled(df: DataFrame, block: Broadcast, more: bool) -> DataFrame:
    """``df``, written before the next block comes, so that workers hold one block at a time."""
    if more:
        df = cut_lineage(df)
        block.destroy()
    return df


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, hits, n_item, containment for every item of which a document holds 80 %."""
    result = None
    for shared, more in blocks_of(benchmark):
        def run(batches, shared=shared):
            for batch in batches:
                block = shared.value
                data, offsets = W.texts_of(batch.column(1))
                rows, items, hits = [], [], []
                for a, b in W.parts(offsets):
                    o = offsets[a:b + 1]
                    for r, i, n in block.found(data[o[0]:o[-1]], o - o[0]):
                        rows.append(a + r)
                        items.append(i)
                        hits.append(n)
                sizes = np.array([len(block.sets[i]) for i in items], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([block.ids[i] for i in items], pa.int64()),
                     pa.array(hits, pa.int64()), pa.array(sizes), pa.array(np.array(hits, float) / np.maximum(sizes, 1))],
                    ["doc_id", "item_id", "hits", "n_item", "containment"])

        own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {OUT}")
        own = settled(own, shared, more)
        result = own if result is None else result.unionByName(own)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {OUT}") if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` (unchanged) that hold no item."""
    at = docs.columns.index("text")
    for shared, more in blocks_of(benchmark):
        def run(batches, shared=shared):
            for batch in batches:
                data, offsets = W.texts_of(batch.column(at))
                fine = np.ones(batch.num_rows, bool)
                for a, b in W.parts(offsets):
                    o = offsets[a:b + 1]
                    for r, _, _ in shared.value.found(data[o[0]:o[-1]], o - o[0]):
                        fine[a + r] = False
                yield batch.filter(pa.array(fine))

        docs = settled(docs.mapInArrow(run, docs.schema), shared, more)
    return docs
