"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Tokens are hashed words and one end token per text. Tasks count their texts' words and
word pairs, combine them, and send packed blocks of sorted hashes to the shards of the
hash space (their number grows with the corpus); a shard adds its blocks up and writes
sorted arrays to the shared folder. Pairs whose first word is very frequent are spread
by the second word, so a word that is a third of all tokens does not fill one shard.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + back(v) * p1(w)
    p1(w)    = max(k(w) - D'(k(w)), 0) / K + g / (V + 1)

k(w) is the number of different words before w, K their sum, V the distinct training
tokens (one place more is for unseen words); D1, D2, D3+ come from the counts of counts,
and are 0.5, 1, 1.5 where these do not give values (tiny corpora). After an unseen word
p = p1. Scoring maps every shard into memory and looks up the sorted distinct hashes of
a batch, so pages are read in order and shared by the workers of a machine.

Null texts count as empty (one end token). Without training text every token has the
uniform probability 1 / (V + 1) = 1. Repeated rows are counted and scored each. An
empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow.llm import words as W
from raceflow.llm.rows import remainder
from raceflow.session import cut_lineage, scratch_path

START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x2545F4914F6CDD1D)
SHARD_BYTES = 16 << 20
FLUSH_TOKENS = 6_000_000
PART_BYTES = 12 << 20
MOST_HOT = 1_024
SMOOTH = 0.1
FALLBACK = (0.0, 0.5, 1.0, 1.5)


@dataclass
class Model:
    folder: str
    bits: int
    hot: np.ndarray
    tokens: int = 0
    types: int = 0
    pairs: int = 0  # distinct pairs
    texts: int = 0
    pair_discounts: tuple = FALLBACK
    word_discounts: tuple = FALLBACK
    spare: float = 1.0  # g: mass of p1 left for all words alike
    start_back: float = 1.0
    _tables: dict = field(default_factory=dict, repr=False)


# ---- tokens and keys ---------------------------------------------------------------------

def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before, words, rows): every row's words and its end, each with the word before."""
    words, bounds = W.hashed_words(data, offsets)
    many = np.diff(bounds)
    n, rows = len(words), len(many)
    row = np.repeat(np.arange(rows), many + 1)
    ends = np.cumsum(many + 1) - 1
    word = np.empty(n + rows, np.uint64)
    inner = np.ones(n + rows, bool)
    inner[ends] = False
    word[inner], word[ends] = words, END
    before = np.empty(n + rows, np.uint64)
    before[1:] = word[:-1]
    before[ends - many] = START
    return before, word, row


def pair_keys(before: np.ndarray, word: np.ndarray, bits: int, hot: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs; the top bits name the shard."""
    mixed = W.mix((before * W.MULTIPLY) ^ word)
    if not bits:
        return mixed
    shift = np.uint64(64 - bits)
    shard = before >> shift
    spread = W.place(hot, before)[1]
    shard = np.where(spread, mixed >> shift, shard)
    low = W.mix(mixed ^ W.FINISH) >> np.uint64(bits)  # not the bits that may name the shard
    return (shard << shift) | low


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their columns."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *[np.add.reduceat(c[order], first) for c in columns]


def _slices(shards: np.ndarray):
    """(shard, from, to) of the runs of a sorted shard column."""
    if len(shards):
        first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]]))
        yield from zip(shards[first].tolist(), first.tolist(), [*first[1:].tolist(), len(shards)])


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


# ---- counting ----------------------------------------------------------------------------

BLOCK = "kind int, shard int, a binary, b binary, c binary"
WORDS, CONTEXT, FOLLOWS, COUNTS, STARTS = range(5)


def _block(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, a, b, c = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()),
         pa.array(c, pa.binary())], ["kind", "shard", "a", "b", "c"])


def _gathered(batches):
    """(before, word) of all texts, at most about FLUSH_TOKENS at a time."""
    held, many = [], 0
    for batch in batches:
        data, offsets = W.texts_of(batch.column(0))
        for a, b in W.parts(offsets):
            o = offsets[a:b + 1]
            before, word, _ = tokens(data[o[0]:o[-1]], o - o[0])
            held.append((before, word))
            many += len(word)
            if many >= FLUSH_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, many = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _word_blocks(batches, bits: int):
    for _, word in _gathered(batches):
        keys, counts = np.unique(word, return_counts=True)
        yield _block([(WORDS, s, keys[i:j].tobytes(), counts[i:j].astype(np.int64).tobytes(), b"")
                      for s, i, j in _slices(_shards(keys, bits))])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _words_added(table: pa.Table, most: int) -> pa.Table:
    """One block of a shard's words; b holds the counts, c the hashes of its most frequent words."""
    keys, counts = _summed(_joined(table["a"], np.uint64), _joined(table["b"], np.int64))
    top = np.argsort(counts)[::-1][:most]
    top = np.stack([keys[top], counts[top].astype(np.uint64)])
    return pa.Table.from_batches([_block([(WORDS, table["shard"][0].as_py(), keys.tobytes(), counts.tobytes(), top.tobytes())])])


def _packed(before: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Distinct pairs by (before, word): each word once, then run lengths and small codes."""
    firsts, at = np.unique(before, return_inverse=True)
    seconds, code = np.unique(word, return_inverse=True)
    order = np.argsort(at * len(seconds) + code)
    runs = np.bincount(at, minlength=len(firsts)).astype(np.uint32)
    small = np.uint16 if len(seconds) <= 65_536 else np.uint32
    head = np.array([len(firsts), len(seconds), len(before)], np.int64)
    return (head.tobytes() + firsts.tobytes() + seconds.tobytes(), runs.tobytes() + code[order].astype(small).tobytes(),
            counts[order].astype(np.uint32).tobytes())


def _unpacked(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, many = np.frombuffer(a, np.int64, 3)
    firsts, seconds = np.frombuffer(a, np.uint64, n, 24), np.frombuffer(a, np.uint64, m, 24 + 8 * n)
    runs = np.frombuffer(b, np.uint32, n)
    code = np.frombuffer(b, np.uint16 if m <= 65_536 else np.uint32, many, 4 * n)
    return np.repeat(firsts, runs), seconds[code], np.frombuffer(c, np.uint32).astype(np.int64)


def _pair_blocks(batches, bits: int, hot: np.ndarray):
    for before, word in _gathered(batches):
        keys, at, counts = np.unique(pair_keys(before, word, bits, hot), return_index=True, return_counts=True)
        before, word = before[at], word[at]
        for s, i, j in _slices(_shards(keys, bits)):
            yield _block([(CONTEXT, s, *_packed(before[i:j], word[i:j], counts[i:j]))])


def write_arrays(folder: str, name: str, **columns: np.ndarray) -> None:
    """Files ``name.column``; written under another name first, so a retried task repeats no harm."""
    store, root = files.FileSystem.from_uri(folder)
    for column, values in columns.items():
        part = f"{root}/part-{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(np.ascontiguousarray(values).tobytes())
        store.move(part, f"{root}/{name}.{column}")


def _pairs_added(table: pa.Table, bits: int, hot: np.ndarray, folder: str) -> pa.Table:
    """Write a shard's pairs; blocks of its contexts and following words, and its counts of counts."""
    before, word, counts = (np.concatenate(x) for x in zip(*(
        _unpacked(*(table[c][i].as_py() for c in "abc")) for i in range(table.num_rows))))
    keys, at = np.unique(pair_keys(before, word, bits, hot), return_inverse=True)
    total = np.bincount(at, counts, len(keys)).astype(np.int64)
    one = np.empty(len(keys), np.int64)
    one[at] = np.arange(len(at))
    before, word = before[one], word[one]
    big = np.flatnonzero(total >= 255)
    shard = table["shard"][0].as_py()
    write_arrays(folder, f"pair-{shard:08d}", key=keys, count=np.minimum(total, 255).astype(np.uint8),
                 big=np.stack([big, total[big]]).astype(np.int64))
    rows = [(COUNTS, 0, np.array([(total == n).sum() for n in (1, 2, 3, 4)] + [len(keys)], np.int64).tobytes(), b"", b"")]
    kinds = [(total == 1).astype(np.int64), (total == 2).astype(np.int64), (total > 2).astype(np.int64)]
    context, *kinds = _summed(before, *kinds)
    start = context == START
    if start.any():
        rows.append((STARTS, 0, np.array([k[start].sum() for k in kinds], np.int64).tobytes(), b"", b""))
    kinds = np.stack(kinds, 1)[~start]
    context = context[~start]
    rows += [(CONTEXT, s, context[i:j].tobytes(), kinds[i:j].astype(np.uint32).tobytes(), b"")
             for s, i, j in _slices(_shards(context, bits))]
    follows, different = np.unique(word, return_counts=True)
    rows += [(FOLLOWS, s, follows[i:j].tobytes(), different[i:j].astype(np.uint32).tobytes(), b"")
             for s, i, j in _slices(_shards(follows, bits))]
    return pa.Table.from_batches([_block(rows)])


def _words_finished(table: pa.Table, folder: str, discounts: tuple) -> pa.Table:
    """Write a shard's words: count, different words before, and the mass left after them."""
    kind = table["kind"].to_numpy()
    own = {k: table.filter(pa.array(kind == k)) for k in (WORDS, CONTEXT, FOLLOWS)}
    keys, counts = _joined(own[WORDS]["a"], np.uint64), _joined(own[WORDS]["b"], np.int64)
    seen, different = _summed(_joined(own[FOLLOWS]["a"], np.uint64), _joined(own[FOLLOWS]["b"], np.uint32).astype(np.int64))
    before = np.zeros(len(keys), np.int64)
    before[np.searchsorted(keys, seen)] = different
    context = _joined(own[CONTEXT]["a"], np.uint64)
    kinds = _joined(own[CONTEXT]["b"], np.uint32).reshape(-1, 3).astype(np.float64)
    context, mass = _summed(context, kinds @ np.array(discounts[1:]))
    back = np.ones(len(keys))
    at = np.searchsorted(keys, context)
    back[at] = mass / counts[at]
    shard = table["shard"][0].as_py()
    write_arrays(folder, f"word-{shard:08d}", key=keys, count=counts, before=before, back=back)
    found = [(before == n).sum() for n in (1, 2, 3, 4)] + [(before > 2).sum()]
    return pa.Table.from_batches([_block([(COUNTS, shard, np.array(found, np.int64).tobytes(), b"", b"")])])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    """(0, D1, D2, D3+); the fallback where a count of counts is 0 or a value leaves 0 … n."""
    if min(n1, n2, n3, n4) <= 0:
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = (0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 <= d <= n for n, d in enumerate(found)) else FALLBACK


def _added(batches, whole: bool):
    for batch in batches:
        rows = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        found = np.zeros(5, np.int64)
        for x in rows:
            found[:1 if whole else len(x)] += x.sum() if whole else x
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in found], [f"x{i}" for i in range(5)])


def _sums(column: DataFrame, whole: bool = False) -> np.ndarray:
    """Sums of stored numbers: place by place, or (``whole``) all of them."""
    each = column.mapInArrow(lambda b: _added(b, whole), ", ".join(f"x{i} long" for i in range(5)))
    row = each.agg(*[F.coalesce(F.sum(f"x{i}"), F.lit(0)).alias(f"x{i}") for i in range(5)]).first()
    return np.array(list(row), np.int64)


def _frequent(batches, limit: float):
    for batch in batches:
        for x in batch.column(0).to_pylist():
            keys, counts = np.frombuffer(x, np.uint64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[counts > limit].view(np.int64))], ["h"])


def train(texts: DataFrame) -> Model:
    """Count the column ``text`` of ``texts`` and write the model to the shared folder."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "kneser-ney")
    store, root = files.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    texts = texts.select("text")
    size, many = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(0, int(np.ceil(np.log2(max(1.0, size / SHARD_BYTES)))))
    shards = 1 << bits
    if not many:
        return Model(folder, 0, np.zeros(0, np.uint64))

    # a shard names enough of its words for every one above the limit to be among them
    top = max(64, 16 * MOST_HOT // shards)
    words = cut_lineage(texts.mapInArrow(lambda b: _word_blocks(b, bits), BLOCK)
                        .groupBy("shard").applyInArrow(lambda t: _words_added(t, top), BLOCK))
    all_tokens, types = _sums(words.select(F.col("b").alias("a")), whole=True)[0], words.agg(
        F.sum(F.octet_length("a").cast("long"))).first()[0] // 8
    limit = all_tokens / (4 * min(MOST_HOT, shards))
    hot = words.select("c").mapInArrow(lambda b: _frequent(b, limit), "h long").collect()  # at most 4 * MOST_HOT
    hot = np.sort(np.append(np.array([r["h"] for r in hot], np.int64).view(np.uint64), START))

    pairs = cut_lineage(texts.mapInArrow(lambda b: _pair_blocks(b, bits, hot), BLOCK)
                        .groupBy("shard").applyInArrow(lambda t: _pairs_added(t, bits, hot, folder), BLOCK))
    counts = _sums(pairs.filter(F.col("kind") == COUNTS).select("a"))
    starts = _sums(pairs.filter(F.col("kind") == STARTS).select("a"))[:3]
    pair_discounts = discounts(*counts[:4].tolist())
    rows = words.withColumn("c", F.lit(b"")).unionByName(pairs.filter(F.col("kind").isin(CONTEXT, FOLLOWS)))
    done = cut_lineage(rows.groupBy("shard").applyInArrow(lambda t: _words_finished(t, folder, pair_discounts), BLOCK))
    found = _sums(done.select("a"))
    word_discounts = discounts(*found[:4].tolist())
    spare = (found[0] * word_discounts[1] + found[1] * word_discounts[2] + found[4] * word_discounts[3]) / counts[4]
    return Model(folder, bits, hot, int(all_tokens), int(types), int(counts[4]), int(many), pair_discounts, word_discounts,
                 float(spare), float(starts @ np.array(pair_discounts[1:]) / many))


# ---- scoring -----------------------------------------------------------------------------

KINDS = {"pair": {"key": np.uint64, "count": np.uint8, "big": np.int64},
         "word": {"key": np.uint64, "count": np.int64, "before": np.int64, "back": np.float64}}


class Arrays:
    """The mapped files of a model. A folder that is not mounted is copied to a temporary one."""

    def __init__(self, model: Model):
        store, root = files.FileSystem.from_uri(model.folder)
        self.model, self.copy = model, None
        if not isinstance(store, files.LocalFileSystem):
            self.copy = tempfile.TemporaryDirectory()
            files.copy_files(root, self.copy.name, source_filesystem=store)
            root = self.copy.name
        self.shards: dict[str, dict[int, dict[str, np.ndarray]]] = {"pair": {}, "word": {}}
        for name in os.listdir(root):
            table, _, rest = name.partition("-")
            if table in KINDS:
                shard, _, column = rest.partition(".")
                kind = KINDS[table][column]
                path = f"{root}/{name}"
                values = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
                self.shards[table].setdefault(int(shard), {})[column] = values

    def find(self, table: str, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
        """The columns at the sorted distinct ``keys``, 0 where absent: one merge per shard."""
        out = [np.zeros(len(keys), KINDS[table][c] if c != "count" else np.int64) for c in columns]
        for shard, i, j in _slices(_shards(keys, self.model.bits)):
            own = self.shards[table].get(shard)
            if own is None:
                continue
            at, hit = W.place(own["key"], keys[i:j])
            at, to = at[hit], np.flatnonzero(hit) + i
            for values, column in zip(out, columns):
                values[to] = own[column][at]
                if table == "pair" and len(own["big"]):
                    where, big = own["big"].reshape(2, -1)
                    many, is_big = W.place(where, at)
                    values[to[is_big]] = big[many[is_big]]
        return out

    def scored(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """tokens, known tokens, base score and score of every row of a part."""
        model, rows = self.model, len(offsets) - 1
        before, word, row = tokens(data, offsets)
        words, at = np.unique(word, return_inverse=True)
        count, different, back = self.find("word", words, "count", "before", "back")
        space = model.types + 1
        base = np.log10((count + SMOOTH) / (model.tokens + SMOOTH * space))
        d1, d2 = np.array(model.word_discounts), np.array(model.pair_discounts)
        p1 = np.maximum(different - d1[np.minimum(different, 3)], 0) / max(model.pairs, 1) + model.spare / space
        # the word before every token: its place among the words, or the start
        starts = before == START
        prior = np.where(starts, 0, np.concatenate([[0], at[:-1]]))
        total = np.where(starts, model.texts, count[prior])
        left = np.where(starts, model.start_back, np.where(count[prior] > 0, back[prior], 1.0))
        p = left * p1[at]
        after_known = np.flatnonzero(total > 0)
        keys, where = np.unique(pair_keys(before[after_known], word[after_known], model.bits, model.hot), return_inverse=True)
        seen = self.find("pair", keys, "count")[0][where]
        p[after_known] += np.maximum(seen - d2[np.minimum(seen, 3)], 0) / total[after_known]
        return (np.bincount(row, minlength=rows), np.bincount(row, count[at] > 0, rows).astype(np.int64),
                np.bincount(row, base[at], rows), np.bincount(row, np.log10(p), rows))


_open: dict[str, Arrays] = {}


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, n_known, base_score and score (log10) of every row."""
    def run(batches):
        if model.folder not in _open:
            _open.clear()
            _open[model.folder] = Arrays(model)
        arrays = _open[model.folder]
        for batch in batches:
            data, offsets = W.texts_of(batch.column(batch.num_columns - 1))
            made = [tuple(np.zeros(0, k) for k in (np.int64, np.int64, float, float))]
            for a, b in W.parts(offsets, PART_BYTES):
                o = offsets[a:b + 1]
                made.append(arrays.scored(data[o[0]:o[-1]], o - o[0]))
            columns = [pa.array(np.concatenate(x)) for x in zip(*made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns],
                                             [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """The contract's columns: learned from the documents outside fold 0, scored for all."""
    held = remainder("doc_id", folds) == 0
    model = train(docs.filter(~held))
    scored = score(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
