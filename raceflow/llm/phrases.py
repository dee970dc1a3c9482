"""Phrase collocations counted in HAT-tries (burstable hash containers under a word-id trie).

1. Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and 0x0A-0x0D, pieces into words
   at spaces and tabs. A word's id is a 64-bit hash; the vocabulary (word, id, count by
   language) is counted over all texts, and if two words share an id, counted again with
   another salt.
2. Phrases are counted by level. A phrase seen ``least`` times has only parts seen
   ``least`` times, so bigrams are counted where both words are frequent, longer phrases
   where all their bigrams are. What is frequent is told to the tasks by a bitmap of a
   fixed size (``BITS``): the more is frequent, the less it saves, and a wrongly set bit only
   lets a rare phrase be counted, to fail by its own count.
3. A task counts in a HAT-trie for each language: a shallow trie over the bytes of the word ids,
   whose leaves are hash containers (phrase -> count); a container of more than ``BURST`` entries
   bursts into a node over the next byte. Beyond ``HELD`` entries the largest subtrees below
   the root are spilled whole, as runs sorted by the ids.
4. Runs are cut and dealt by prefix: language and the first bits of the first word's id, as many as
   make parts of some ``PART`` occurrences; the phrases of a word with more are cut further by
   a hash of the next word, into as many parts as a byte table of a fixed size says. The runs of a
   prefix are merged in its partition; sums below ``least`` go.
5. Every candidate is cut at each place, the counts of its parts are joined (salted, since many
   phrases share a part), and the lowest floor(2000000 a / (l + r)) counts, ties to the
   first cut. Sums and products are exact (decimals of 38 digits). A candidate inside a longer one
   with 100 f(longer) >= 80 a goes. Texts of phrases are looked up only for rows that can be
   among the first ``top`` of their language.

Null texts and texts without words have no phrases; a null lang is ``und``. Repeated rows count
each. Ties are broken by a, then by the phrase in byte order. Long texts are read whole, in
batches of 2 MB or one text. An empty table gives an empty result. Only text and lang are read.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from raceflow.llm import words as W
from raceflow.session import cut_lineage

LEAST = 30
WORDS = (2, 3, 4)
TOP = 2_000
SCALE = 2_000_000
COVER = 80
BURST = 1 << 14  # entries of a container
HELD = 1 << 19  # entries of a task's trie
BATCH = 2 << 20  # bytes of text, or one longer text, read at a time
PART = 1 << 21  # occurrences of first words that stay in one part
BITS = 1 << 27
SLOTS = 1 << 20
MERGE = 1 << 19  # entries merged at a time
SALTS = 8
RUN = "lang string, part long, words int, ids binary, counts binary"

CUT = np.zeros(256, bool)
CUT[[ord(c) for c in ".,;:!?"]] = True
CUT[10:14] = True
GAP = CUT.copy()
GAP[[9, 32]] = True


class Words:
    """The words of a part: ids, whether each is followed by one of its piece, and its row's language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, salt: int):
        self.starts, self.lengths, rows = W.spans(data, offsets, GAP)
        self.ids = W.salted(W.hash_spans(W.LOWER[data], self.starts, self.lengths), salt) if len(rows) else np.zeros(0, np.uint64)
        piece = np.concatenate([[0], np.cumsum(CUT[data])])[self.starts]
        self.joined = np.append((rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1]), False)[:len(rows)]
        self.lang = lang[rows]


def _parts(batches, salt: int, langs: dict[str, int]):
    """(lower-cased bytes, words) of each part; languages are numbered in ``langs`` as they come."""
    for batch in batches:
        data, offsets = W.texts_of(batch.column(0))
        lang = np.array([langs.setdefault(x if x is not None else "und", len(langs)) for x in batch.column(1).to_pylist()], np.int64)
        for a, b in W.parts(offsets, BATCH):
            o = offsets[a:b + 1]
            yield W.LOWER[data[o[0]:o[-1]]], Words(data[o[0]:o[-1]], o - o[0], lang[a:b], salt)


def _vocabulary(batches, salt: int):
    """lang, id, word and count of a part's distinct words."""
    langs: dict[str, int] = {}
    for data, w in _parts(batches, salt, langs):
        if not len(w.ids):
            continue
        order = np.lexsort((w.ids, w.lang))
        ids, lang = w.ids[order], w.lang[order]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (lang[1:] != lang[:-1])]))
        many, at = np.diff(np.append(first, len(ids))), order[first]
        raw, begin = data.tobytes(), w.starts[at]
        text = [raw[s:e] for s, e in zip(begin.tolist(), (begin + w.lengths[at]).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(langs)).take(pa.array(lang[first])), pa.array(ids[first].view(np.int64)),
             pa.array(text, pa.binary()).cast(pa.string()), pa.array(many.astype(np.int64))], ["lang", "id", "word", "n"])


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, id, word, n) of all words, stored, and the salt under which no two words of a language share an id."""
    salt = 0
    while True:
        parts = docs.select("text", F.col("lang").cast("string")).mapInArrow(
            partial(_vocabulary, salt=salt), "lang string, id long, word string, n long")
        table = cut_lineage(parts.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")))
        if table.groupBy("lang", "id").agg(F.count(F.lit(1)).alias("names")).filter("names > 1").isEmpty():
            return table, salt
        salt += 1


def slots(lang: np.ndarray, ids: list[np.ndarray], size: int) -> np.ndarray:
    """The bit of a phrase (its language's own hash and its ids) in a table of ``size``."""
    h = lang.copy()
    for x in ids:
        h = W.mix((h ^ x) * W.MULTIPLY)
    return (h % np.uint64(size)).astype(np.int64)


def lang_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return W.hash_spans(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]


def _slots(batches, size: int):
    """The table slot of every phrase (lang, path), with its weight."""
    for batch in batches:
        lang = np.array([lang_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
        path = batch.column(1).to_pylist()
        many = len(path[0]) // 8 if path else 1
        ids = np.frombuffer(b"".join(path), ">u8").reshape(-1, many).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(slots(lang, list(ids.T), size)), batch.column(2)], ["slot", "n"])


def bitmap(phrases: DataFrame) -> np.ndarray:
    """``BITS`` bits, set where a phrase of (lang, path, n) falls; at most BITS / 64 numbers reach the driver."""
    at = phrases.select("lang", "path", "n").mapInArrow(partial(_slots, size=BITS), "slot long, n long")
    word = at.select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
    rows = word.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def shares(words: DataFrame) -> np.ndarray:
    """Log2 of the parts into which a first word's runs are cut, by slot of the word; at most SLOTS bytes."""
    often = words.filter(F.col("n") > PART).select("lang", "path", "n")
    at = often.mapInArrow(partial(_slots, size=SLOTS), "slot long, n long")
    power = F.least(F.ceil(F.log2(F.col("n") / PART)), F.lit(24)).cast("int")
    rows = at.groupBy("slot").agg(F.max(power).alias("power")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[rows.column("slot").to_numpy()] = rows.column("power").to_numpy()
    return table


def is_set(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Node(dict):
    """Children (containers or nodes) by the next byte of the ids."""


class Trie:
    """Counts of phrases: a trie over the bytes of the word ids by language, whose leaves are hash containers that burst."""

    def __init__(self, many: int, burst: int = BURST, held: int = HELD):
        self.roots: dict[int, Node] = {}
        self.sizes: dict[tuple[int, int], int] = {}  # entries below (language, first byte)
        self.many, self.burst, self.held, self.total = many, burst, held, 0

    def add(self, lang: int, ids: list[np.ndarray], counts: np.ndarray) -> None:
        """Adds phrases of a language, sorted by their ids (a column a word)."""
        raw, wide = np.stack(ids, axis=1).astype(">u8").tobytes(), 8 * self.many
        keys, many, root = [raw[i:i + wide] for i in range(0, len(raw), wide)], counts.tolist(), self.roots.setdefault(lang, Node())
        for byte, lo, hi in self._split(ids, 0, 0, len(keys)):
            grown = self._put(root, byte, ids, keys, many, 0, lo, hi)
            self.sizes[lang, byte] = self.sizes.get((lang, byte), 0) + grown
            self.total += grown

    @staticmethod
    def _split(ids: list[np.ndarray], depth: int, lo: int, hi: int):
        at = ((ids[depth // 8][lo:hi] >> np.uint64(56 - 8 * (depth % 8))) & np.uint64(255)).astype(np.uint8)
        begin = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        return zip(at[begin].tolist(), (begin + lo).tolist(), np.append(begin[1:] + lo, hi).tolist())

    def _put(self, node: Node, byte: int, ids, keys, counts, depth: int, lo: int, hi: int) -> int:
        box = node.get(byte)
        if box is None:
            box = node[byte] = {}
        if isinstance(box, Node):
            return sum(self._put(box, b, ids, keys, counts, depth + 1, i, j) for b, i, j in self._split(ids, depth + 1, lo, hi))
        before, get = len(box), box.get
        for key, n in zip(keys[lo:hi], counts[lo:hi]):
            box[key] = get(key, 0) + n
        grown = len(box) - before
        if len(box) > self.burst:
            node[byte] = self._burst(box, depth + 1)
        return grown

    def _burst(self, box: dict[bytes, int], depth: int):
        if len(box) <= self.burst or depth == 8 * self.many:
            return box
        node = Node()
        for key, n in box.items():
            node.setdefault(key[depth], {})[key] = n
        for byte, child in node.items():
            node[byte] = self._burst(child, depth + 1)
        return node

    def run(self, lang: int, byte: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes a whole subtree off, as a sorted run: ids (a row a phrase) and counts."""
        keys, counts, left = [], [], [self.roots[lang].pop(byte)]
        self.total -= self.sizes.pop((lang, byte))
        while left:
            box = left.pop()
            if isinstance(box, Node):
                left += box.values()
            else:
                keys += box
                counts += box.values()
        ids = np.frombuffer(b"".join(keys), ">u8").reshape(-1, self.many).astype(np.uint64)
        order = np.lexsort(ids.T[::-1])
        return ids[order], np.array(counts, np.int64)[order]

    def spill(self, keep: int):
        """(language, ids, counts): runs of the largest subtrees, until at most ``keep`` entries are left."""
        for key in sorted(self.sizes, key=lambda k: (-self.sizes[k], k)):
            if self.total <= keep:
                break
            yield key[0], *self.run(*key)


def parts_of(ids: np.ndarray, lang: np.uint64, depth: int, cut: np.ndarray) -> np.ndarray:
    """The part of each phrase: ``depth`` bits of its first word's id, and for common words more bits of the next word's hash."""
    power = cut[slots(np.full(len(ids), lang), [ids[:, 0]], SLOTS)].astype(np.int64)
    part = (ids[:, 0] >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(ids), np.int64)
    more = np.zeros(len(ids), np.int64)
    at = np.flatnonzero(power)
    more[at] = (W.mix(ids[at, 1]) >> (64 - power[at]).astype(np.uint64)).astype(np.int64) + 1
    return part << 25 | more


def _runs(batches, sizes: tuple[int, ...], salt: int, depth: int, known, cuts, burst: int, held: int):
    """Sorted runs (RUN) of the phrases of ``sizes`` words whose parts are all in the bitmap ``known``."""
    langs: dict[str, int] = {}
    hashes: list[np.uint64] = []
    tries = {k: Trie(k, burst, held // len(sizes)) for k in sizes}
    bits, cut = known.value, cuts.value

    def rows(many: int, taken) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(4)]
        names = list(langs)
        for lang, ids, counts in taken:
            part = parts_of(ids, hashes[lang], depth, cut)
            order = np.argsort(part, kind="stable")
            begin = np.append(0, np.flatnonzero(np.diff(part[order])) + 1)
            for own in np.split(order, begin[1:]):
                for to, value in zip(out, (names[lang], int(part[own[0]]), ids[own].T.tobytes(), counts[own].tobytes())):
                    to.append(value)
        made = [pa.array(o, k) for o, k in zip(out, (pa.string(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*made[:2], pa.array(np.full(len(out[0]), many, np.int32)), *made[2:]],
                                          ["lang", "part", "words", "ids", "counts"])

    for _, w in _parts(batches, salt, langs):
        hashes += [lang_hash(x) for x in list(langs)[len(hashes):]]
        if not len(w.ids):
            continue
        own = np.array(hashes, np.uint64)[w.lang]
        if sizes == (2,):
            fine = is_set(bits, slots(own, [w.ids], BITS))
            pair = w.joined & fine & np.append(fine[1:], False)
        else:
            pair = w.joined.copy()
            at = np.flatnonzero(pair)
            pair[at] = is_set(bits, slots(own[at], [w.ids[at], w.ids[at + 1]], BITS))
        for many in sizes:
            whole = pair.copy()
            for k in range(1, many - 1):
                whole[:-k] &= pair[k:]
                whole[-k:] = False
            for lang in range(len(langs)):
                at = np.flatnonzero(whole & (w.lang == lang))
                if not len(at):
                    continue
                ids = [w.ids[at + k] for k in range(many)]
                order = np.lexsort(ids[::-1])
                ids = [x[order] for x in ids]
                new = np.zeros(len(order), bool)
                new[0] = True
                for x in ids:
                    new[1:] |= x[1:] != x[:-1]
                first = np.flatnonzero(new)
                tries[many].add(lang, [x[first] for x in ids], np.diff(np.append(first, len(order))))
            if tries[many].total > tries[many].held:
                yield rows(many, tries[many].spill(tries[many].held // 2))
    for many, trie in tries.items():
        if trie.total:
            yield rows(many, trie.spill(0))


def _merged(batches, least: int):
    """Rows come by (lang, part, words): their runs added up; phrases of ``least`` or more."""
    held, entries = [], 0

    def flush(rows: list) -> pa.RecordBatch:
        langs: dict[str, int] = {}
        kinds: dict[int, list] = {}
        for lang, _, many, ids, counts in rows:
            kinds.setdefault(many, []).append((langs.setdefault(lang, len(langs)), np.frombuffer(ids, np.uint64).reshape(many, -1),
                                               np.frombuffer(counts, np.int64)))
        names, out = pa.array(list(langs)), []
        for many, runs in kinds.items():
            ids, counts = np.concatenate([r[1] for r in runs], axis=1), np.concatenate([r[2] for r in runs])
            lang = np.repeat(np.array([r[0] for r in runs]), [len(r[2]) for r in runs])
            order = np.lexsort((*ids[::-1], lang))
            ids, lang = ids[:, order], lang[order]
            new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (ids[:, 1:] != ids[:, :-1]).any(axis=0)])
            at = np.flatnonzero(new)
            total = np.add.reduceat(counts[order], at)
            at, total = at[total >= least], total[total >= least]
            raw, wide = ids[:, at].T.astype(">u8").tobytes(), 8 * many
            path = pa.array([raw[i:i + wide] for i in range(0, len(raw), wide)], pa.binary())
            out.append(pa.RecordBatch.from_arrays([names.take(pa.array(lang[at])), path, pa.array(np.full(len(at), many, np.int32)), pa.array(total)],
                                                  ["lang", "path", "words", "n"]))
        return out

    last = None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if row[:3] != last and entries >= MERGE:
                yield from flush(held)
                held, entries = [], 0
            last = row[:3]
            held.append(row)
            entries += len(row[4]) // 8
    if held:
        yield from flush(held)


def frequent(docs: DataFrame, sizes: tuple[int, ...], salt: int, depth: int, known, cuts, least: int, burst: int = BURST,
             held: int = HELD) -> DataFrame:
    """(lang, path, words, n) of the phrases seen ``least`` times; stored."""
    runs = docs.select("text", F.col("lang").cast("string")).mapInArrow(
        partial(_runs, sizes=sizes, salt=salt, depth=depth, known=known, cuts=cuts, burst=burst, held=held), RUN)
    runs = runs.repartition("lang", "part").sortWithinPartitions("lang", "part", "words")
    return cut_lineage(runs.mapInArrow(partial(_merged, least=least), "lang string, path binary, words int, n long"))


def _exact(c: str | Column, digits: int = 20) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def _counted(cuts: DataFrame, known: DataFrame, side: str, name: str) -> DataFrame:
    """``cuts`` with the count of one side, salted on both sides."""
    salted = known.select(F.col("lang"), F.col("path").alias(side), F.col("n").alias(name),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return cuts.join(salted, ["lang", side, "salt"])


def score(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (lang, path, words, n) with l, r and score of their lowest-scoring cut."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "path", "words", "n", "k", F.expr("substring(path, 1, 8 * k)").alias("left"),
                       F.expr("substring(path, 8 * k + 1, 8 * (words - k))").alias("right"),
                       F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    both = _counted(_counted(cuts, known, "left", "l"), known, "right", "r")
    both = both.select("lang", "path", "words", "n", "k", "l", "r", (_exact(F.lit(SCALE), 7) * _exact("n")).alias("top"),
                       (_exact("l") + _exact("r")).alias("bottom"))
    both = both.withColumn("score", F.expr("top div bottom").cast("long"))
    best = both.groupBy("lang", "path", "words", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "path", "words", "n", "b.score", "b.l", "b.r")


def uncovered(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored`` without phrases inside a longer candidate that has ``COVER`` percent of their count."""
    inner = F.expr("""flatten(transform(sequence(2, words - 1), k ->
        transform(sequence(0, words - k), i -> substring(path, 8 * i + 1, 8 * k))))""")
    inside = candidates.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("path"), F.col("n").alias("longer"))
    most = inside.groupBy("lang", "path").agg(F.max("longer").alias("longer"))
    covered = _exact("longer") * 100 >= _exact("n") * COVER
    return scored.join(most, ["lang", "path"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("longer")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, burst: int = BURST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    spark = docs.sparkSession
    docs = docs.select("text", F.col("lang").cast("string"))
    words, salt = vocabulary(docs)
    path = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("all_words"))
    often = cut_lineage(words.filter(F.col("n") >= least).select("lang", path.alias("path"), F.lit(1).alias("words"), "n", "word", "id"))
    cuts = spark.sparkContext.broadcast(shares(often))
    known = spark.sparkContext.broadcast(bitmap(often))
    every = words.agg(F.sum("n")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, every / PART))))
    pairs = frequent(docs, (2,), salt, depth, known, cuts, least, burst, held)
    known = spark.sparkContext.broadcast(bitmap(pairs))
    longer = frequent(docs, (3, 4), salt, depth, known, cuts, least, burst, held)

    candidates = pairs.unionByName(longer)
    counts = often.select("lang", "path", "n").unionByName(candidates.select("lang", "path", "n"))
    left = cut_lineage(uncovered(candidates, score(candidates, counts)))
    falling = [F.desc("score"), F.desc("n")]
    for group in (["lang", F.pmod(F.xxhash64("path"), F.lit(SALTS))], ["lang"]):  # ties at the last place all stay
        left = left.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(*falling))).filter(F.col("place") <= top).drop("place")
    left = cut_lineage(left)
    spelled = left.select("lang", "path", F.posexplode(F.expr("transform(sequence(0, words - 1), i -> substring(path, 8 * i + 1, 8))")).alias("i", "at"))
    spelled = spelled.join(often.select("lang", F.col("path").alias("at"), "word"), ["lang", "at"]).groupBy("lang", "path").agg(
        F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])).alias("phrase"))  # four words
    named = left.join(spelled, ["lang", "path"]).join(totals, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*falling, "phrase"))
    return named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("all_words").alias("n"), "score")
