"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. A text's words are lower-cased (A-Z) and joined by single spaces; every ``SHINGLE``-word
   shingle, repeats included, is hashed by XXH64 (UTF-8 bytes, seed 42). A bit of the
   64-bit fingerprint is 1 if it is set in over half of the hashes.
2. Two fingerprints at ``RADIUS`` or fewer differing bits have a variant in common that lies
   within half the radius of both. So each distinct fingerprint emits all its variants
   within half the radius (2,081 for a radius of 4), the variants are brought together by a
   shuffle, and fingerprints that meet in a variant are verified and linked.
3. The shuffle moves no variant by itself: variants are dealt by some of their bits (the most
   balanced ones), and one row a fingerprint and target (its bits, the flips it has left)
   stands for all its variants there, which the receiving task writes out and sorts. The
   number of bits follows the number of fingerprints, so that a group has some
   ``GROUP`` variants; a group with more is dealt again by further bits until it has not, or
   until its rows share all 64 bits (2,081 fingerprints at most).
4. A group gives a spanning forest of its links, never pairs; components follow by star joins.

Texts with fewer words than a shingle have one shingle, the whole sequence. Texts without words
(null, empty, white space) have fingerprint zero and are linked like any other. Every row is
labelled by its own text, also where rows repeat a doc_id. A null doc_id gets a fingerprint,
but no component (null), and links nothing. Very long texts are hashed in runs of ``RUN``
shingles. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow.llm.components import connected
from raceflow.llm.rows import join_hot
from raceflow.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
RUN = 1 << 16
GROUP = 1 << 21  # variants that a task holds at a time
MORE_BITS = 8


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    joined = b" ".join((text or "").encode().lower().split())  # bytes: only A-Z and ASCII white space
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    size = min(SHINGLE, len(starts))
    starts, ends = starts[:len(starts) - size + 1], ends[size - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), RUN):
        a, b = starts[at:at + RUN].tolist(), ends[at:at + RUN].tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of every choice of at most ``most`` of ``bits``."""
    return [(sum(1 << b for b in chosen), n) for n in range(most + 1) for chosen in combinations(bits, n)]


def variants(left: Column, free: int, most: int) -> Column:
    """How many variants ``left`` more flips among ``free`` bits make."""
    counts = [sum(math.comb(free, i) for i in range(n + 1)) for n in range(most + 1)]
    return F.get(F.array(*[F.lit(c).cast("long") for c in counts]), left)


def deal(rows: DataFrame, bits: list[int], most: int) -> DataFrame:
    """A row (fp, v, left) for every target that its variants reach by these bits."""
    choices = F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.lit(n).alias("cost")) for m, n in flips(bits, most)])
    spread = rows.select("*", F.explode(choices).alias("c")).filter("c.cost <= left")
    return spread.select("fp", F.col("v").bitwiseXOR(F.col("c.mask")).alias("v"), (F.col("left") - F.col("c.cost")).alias("left"))


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest of the pairs: those that join two trees, in order."""
    up, forest = list(range(n)), []
    for x, y in zip(a.tolist(), b.tolist()):
        i, j = x, y
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[max(i, j)] = min(i, j)
            forest.append((x, y))
    return forest


def meet(fp: np.ndarray, v: np.ndarray, left: np.ndarray, masks: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links (positions) of the fingerprints of a group that meet in a variant."""
    made, owner = [], []
    for n, mask in enumerate(masks):
        who = np.flatnonzero(left == n)
        made.append((v[who][:, None] ^ mask[None, :]).reshape(-1))
        owner.append(np.repeat(who.astype(np.int32), len(mask)))
    made, owner = np.concatenate(made), np.concatenate(owner)
    order = np.argsort(made, kind="stable")
    made, owner = made[order], owner[order]
    first = np.concatenate([[True], made[1:] != made[:-1]])
    head = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
    a, b = head[~first].astype(np.int64), owner[~first].astype(np.int64)
    pairs = np.unique(np.minimum(a, b) * len(fp) + np.maximum(a, b))
    a, b = pairs // len(fp), pairs % len(fp)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    return spanning(a[near], b[near], len(fp))


def _meet(batches, bits: list[int], radius: int):
    """Rows come by key; the links (u, v) of each group."""
    masks = [np.array([m for m, _ in flips(bits, n)], np.uint64) for n in range(radius // 2 + 1)]
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        fp, v = rows[1].view(np.uint64), rows[2].view(np.uint64)
        found = np.array(meet(fp, v, rows[3], masks, radius) or np.zeros((0, 2)), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[1][found[:, k]]) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        rows = np.array([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        for part in np.split(rows, cuts, axis=1):
            if not part.shape[1]:
                continue
            if held and held[0][0, 0] != part[0, 0]:
                yield links(np.concatenate(held, axis=1))
                held = []
            held.append(part)
    if held:
        yield links(np.concatenate(held, axis=1))


def balanced_bits(fps: DataFrame) -> list[int]:
    """The 64 bit numbers, those set in nearest to half of the fingerprints first."""
    ones = fps.agg(F.count(F.lit(1)), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64)]).first()
    return sorted(range(64), key=lambda i: (abs(2 * (ones[i + 1] or 0) - ones[0]), i))


def links(fps: DataFrame, many: int, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Links (u, v) that tie all distinct fingerprints ``fps`` (fp; ``many`` rows, stored) at ``radius`` or fewer bits.

    ``radius`` is even; the links are enough for the components, not every pair.
    """
    most, order = radius // 2, balanced_bits(fps)
    each = sum(math.comb(64, i) for i in range(most + 1))
    depth = min(64, max(0, math.ceil(math.log2(max(1, many * each / group)))))
    rows = deal(fps.select("fp", F.col("fp").alias("v"), F.lit(most).alias("left")), order[:depth], most)
    found = []
    while True:
        mask = _signed(sum(1 << b for b in order[:depth]))
        rows = cut_lineage(rows.withColumn("key", F.col("v").bitwiseAND(F.lit(mask).cast("long"))))
        sizes = rows.groupBy("key").agg(F.sum(variants(F.col("left"), 64 - depth, most)).alias("many"))
        large = cut_lineage(sizes.filter(F.col("many") > group).select("key"))
        again = depth < 64 and not large.isEmpty()
        fit = rows.join(large, "key", "left_anti") if again else rows
        fit = fit.select("key", "fp", "v", "left").repartition("key").sortWithinPartitions("key")
        found.append(fit.mapInArrow(partial(_meet, bits=order[depth:], radius=radius), "u long, v long"))
        if not again:
            break
        more = order[depth:depth + MORE_BITS]
        rows, depth = deal(rows.join(large, "key", "left_semi"), more, most), depth + len(more)
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole.distinct()


def components(docs: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    rows = cut_lineage(fingerprints(docs))
    classes = cut_lineage(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many")))
    found = connected(links(classes.select("fp"), classes.count(), radius, group))
    found = cut_lineage(found.withColumnRenamed("node", "fp").join(classes.select("fp", "rep"), "fp"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(found.join(least, "component").select("fp", "component_id"), "fp", "left")
    named = cut_lineage(named.select("fp", "many", F.coalesce("component_id", "rep").alias("component_id")))
    labelled = join_hot(rows, named, ["fp"], "many", rows.count())
    return labelled.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                           F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
