"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of ``words``-word shingles (four unless given) and a MinHash signature. Rows with
   equal sets (equal size and 128-bit digest) form a class; its smallest doc_id stands for it.
2. Signatures are cut into ``BANDS`` bands of ``ROWS`` values; classes with an equal band are candidates. At
   a similarity of exactly 0.8 all bands differ with probability (1 - 0.8^5)^36 = 6e-7.
3. A candidate pair's signatures are compared batch by batch; it is pruned when the
   posterior probability (uniform prior) of a similarity of 0.8 or more falls below ``MISS``.
   Survivors are verified on the full sets of their whole texts.
4. First each bucket's smallest document is compared with the others (no pairs among
   them). Documents of buckets that still hold several components are then gathered by
   families (components tied by such buckets), families cut into blocks, and every two
   blocks compared in a task. Only pairs of documents not yet in one component are looked
   at, and only links leave the task, never pairs.

A text with fewer words than a shingle is one shingle, the whole sequence; texts without words
(null, empty, white space) have an empty set and are linked with nothing. Rows with the
same doc_id are one document. A null doc_id is linked with nothing and kept. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow.llm import words as W
from raceflow.llm.components import connected
from raceflow.session import cut_lineage, release

WORDS = 4
ROWS, BANDS = 5, 36
PERCENT = 80
MISS = 1e-6
BATCH = 20
BLOCK = 64  # documents compared with one copy of their pivot
FAMILY_BLOCK = 512  # documents of a family block

_random = np.random.default_rng(7)
FACTOR = _random.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSET = _random.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FACTOR), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        part = x[at:at + 1024]
        np.minimum(best, (FACTOR[:, None] * part[None, :] + OFFSET[:, None]).min(axis=1), out=best)
    return best


def _profiles(batches, size: int):
    """doc_id, n, two digests of the set, the band hashes, and one byte of each signature value."""
    for batch in batches:
        data, offsets = W.texts_of(batch.column(1))
        n, digests, sigs = [], [], []
        for a, b in W.parts(offsets):
            o = offsets[a:b + 1]
            words, bounds = W.hashed_words(data[o[0]:o[-1]], o - o[0])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                own = np.unique(W.shingles(words[lo:hi], size))
                n.append(len(own))
                digests.append((np.add.reduce(W.mix(own)), np.bitwise_xor.reduce(W.mix(own ^ W.FINISH))))
                sigs.append(signature(own) if len(own) else np.zeros(len(FACTOR), np.uint32))
        sig = np.array(sigs, np.uint32).reshape(len(n), BANDS, ROWS).astype(np.uint64)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * W.MULTIPLY, (len(n), BANDS)).copy()
        for k in range(ROWS):
            band = (band ^ sig[:, :, k]) * W.MULTIPLY
            band ^= band >> W.SHIFT
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS),
                                         pa.array(W.mix(band).reshape(-1).view(np.int64)))
        low = (sig & np.uint64(255)).astype(np.uint8).reshape(len(n), -1)
        digests = np.array(digests, np.uint64).reshape(len(n), 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), bands,
             pa.array([r.tobytes() for r in low], pa.binary())], ["doc_id", "n", "d1", "d2", "bands", "sig"])


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(_profiles, size=words), "doc_id long, n long, d1 long, d2 long, bands array<bigint>, sig binary")


def least_matches(batch: int = BATCH, miss: float = MISS, percent: int = PERCENT) -> list[int]:
    """Matches needed after each batch of compared bytes for the pair to stay.

    With m matches of c, the posterior of the similarity s is proportional to the
    likelihood p^m (1 - p)^(c - m), p = s + (1 - s) / 256 (bytes also match by chance).
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    high, needed = s >= percent / 100, []
    for c in range(batch, ROWS * BANDS + 1, batch):
        for m in range(c + 1):
            like = m * np.log(p) + (c - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[high].sum() >= miss * like.sum():
                needed.append(m)
                break
    return needed


def _plausible(batches):
    """Pairs whose signatures leave a similarity of 0.8 possible."""
    needed = least_matches()
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for i in (2, 3))
        alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, int)
        for k, m in enumerate(needed):
            at = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (a[alive, at] == b[alive, at]).sum(axis=1)
            stay = matches >= m
            alive, matches = alive[stay], matches[stay]
        yield batch.select([0, 1]).take(pa.array(alive))


def _near(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def prune(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The plausible ones of ``pairs`` (a, b)."""
    sig = reps.select("doc_id", "sig")
    both = (pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b"))
    return both.mapInArrow(_plausible, "a long, b long")


def _verified(batches, size: int):
    """Rows come by (a, chunk) with the pivot's text first; links between it and the others."""
    key, pivot = None, None
    for batch in batches:
        a, chunk, role, doc = (batch.column(i).to_pylist() for i in range(4))
        data, offsets = W.texts_of(batch.column(4))
        left, right = [], []
        for lo, hi in W.parts(offsets):
            o = offsets[lo:hi + 1]
            words, bounds = W.hashed_words(data[o[0]:o[-1]], o - o[0])
            for i in range(lo, hi):
                own = np.unique(W.shingles(words[bounds[i - lo]:bounds[i - lo + 1]], size))
                if role[i] == 0:
                    key, pivot = (a[i], chunk[i]), own
                elif key == (a[i], chunk[i]):
                    common = int(W.place(pivot, own)[1].sum())
                    if common and 100 * common >= PERCENT * (len(pivot) + len(own) - common):
                        left.append(a[i])
                        right.append(doc[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def verify(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The links (u, v) among ``pairs`` (a, b). A pivot's documents are cut into blocks with a copy of it each."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    blocks = pairs.join(many, "a").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / BLOCK)).cast("int").alias("chunk"))
    wanted = blocks.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(1).alias("role")).unionByName(
        blocks.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(0).alias("role")).distinct())
    rows = wanted.join(texts, "doc_id").select("a", "chunk", "role", "doc_id", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role", "doc_id")
    return rows.mapInArrow(partial(_verified, size=words), "u long, v long").distinct()


def _unit_links(block: np.ndarray, component: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], needed: list[int]):
    """Links (x, y) between documents of different components: inside one block, or across two."""
    order = np.argsort(block, kind="stable")
    n = np.array([len(x) for x in sets])
    _, label = np.unique(component, return_inverse=True)
    split = int((block[order] == block[order[0]]).sum())
    across = split < len(order)
    for at in range(split if across else len(order)):
        x = order[at]
        others = order[split:] if across else order[at + 1:]
        others = others[label[others] != label[x]]
        small, large = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
        others = others[100 * small >= PERCENT * large]
        matches = np.zeros(len(others), int)
        for k, m in enumerate(needed):
            if not len(others):
                break
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches = matches + (sigs[others, part] == sigs[x, part]).sum(axis=1)
            others, matches = others[matches >= m], matches[matches >= m]
        if not len(others):
            continue
        hits = W.place(sets[x], np.concatenate([sets[y] for y in others]))[1]
        ends = np.cumsum(n[others])
        total = np.concatenate([[0], np.cumsum(hits)])
        common = total[ends] - total[ends - n[others]]
        for y in others[100 * common >= PERCENT * (n[x] + n[others] - common)]:
            if label[y] != label[x]:  # not joined by a link found meanwhile
                label[label == label[y]] = label[x]
                yield x, y


def _family_links(batches, size: int):
    """Rows come by unit (family, i, j): the documents of one or two blocks."""
    needed = least_matches()
    held: list = []

    def links():
        block, component = (np.array([r[k] for r in held]) for k in (3, 4))
        sigs = np.frombuffer(b"".join(r[6] for r in held), np.uint8).reshape(len(held), -1)
        column = pa.array([r[7] for r in held], pa.string())
        data, offsets = W.texts_of(column)
        words, bounds = W.hashed_words(data, offsets)
        sets = [np.unique(W.shingles(words[a:b], size)) for a, b in zip(bounds[:-1], bounds[1:])]
        found = [(held[x][5], held[y][5]) for x, y in _unit_links(block, component, sigs, sets, needed)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if held and held[0][:3] != row[:3]:
                yield links()
                held = []
            held.append(row)
    if held:
        yield links()


def across(shared: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The links (u, v) between components that share a bucket."""
    labelled = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    still_open = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    opened = cut_lineage(labelled.join(still_open.select("key", "low"), "key").select("doc_id", "component", "low").distinct())
    families = connected(opened.select(F.col("component").alias("u"), F.col("low").alias("v")))
    families = families.select(F.col("node").alias("component"), F.col("component").alias("family"))
    members = cut_lineage(opened.select("doc_id", "component").distinct().join(families, "component"))
    blocks = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("blocks"))
    units = members.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "component", "doc_id")
    rows = units.join(reps.select("doc_id", "sig"), "doc_id").join(texts, "doc_id")
    rows = rows.select("family", "i", "j", "block", "component", "doc_id", "sig", "text")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "block", "doc_id")
    return rows.mapInArrow(partial(_family_links, size=words), "u long, v long").distinct()


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = cut_lineage(profiles(docs, words))
    with_words = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = with_words.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    reps = (with_words.join(classes, ["n", "d1", "d2"]).filter("doc_id = rep")
            .select("doc_id", "n", "bands", "sig"))
    reps = cut_lineage(reps)

    bands = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("many"),
                                       F.min("n").alias("least"), F.max("n").alias("most")).filter("many > 1")
    shared = cut_lineage(bands.join(buckets.select("key", "pivot"), "key"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        shared.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = cut_lineage(texts)

    sizes = reps.select(F.col("doc_id").alias("pivot"), F.col("n").alias("n_pivot"))
    first = (shared.filter("doc_id <> pivot").select(F.col("pivot"), F.col("doc_id").alias("b"), "n").distinct()
             .join(sizes, "pivot").filter(_near(F.col("n"), F.col("n_pivot")))
             .select(F.col("pivot").alias("a"), "b").distinct())
    first = cut_lineage(prune(first, reps))
    links = cut_lineage(verify(first, texts, words))
    found = cut_lineage(connected(links))

    more = cut_lineage(across(shared, found, reps, texts, words))
    release(docs.sparkSession)
    if not more.isEmpty():
        found = connected(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    named = rows.join(classes, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).alias("rep"))
    named = named.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    labels = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return labels.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` (unchanged): the smallest doc_id of each component, and null ids."""
    gone = components(docs, words).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
