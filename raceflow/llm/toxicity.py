"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from labelled rows: words, and word beginnings of 4 to 7
characters, that occur in toxic documents far more often than in others. Training rows
get their lexicon features from the other half's lexicon, so the trees see the same
kind of hit that unseen texts give. Dense features: lexicon densities, their nearness
to second-person words, capitals, punctuation and obfuscation (characters inside words
that stand for letters), all per word or character of the whole text.

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows
(``most_rows``, chosen by a hash of the id); every text is scored in whole. Null texts
count as empty, empty texts get the score of their (zero) features. Labels repeated for
a document count once, the larger toxic wins. With one class or no label at all the
score is the share of toxic labels, 0 without any. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow.llm import words as W
from raceflow.llm.rows import remainder
from raceflow.session import cut_lineage

THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)
NEAR = 5
LEAST_TOXIC = 3
LEAST_ODDS = 2.0
MOST_ENTRIES = 4_000
SECOND_PERSON = ("you your yours yourself du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos "
                 "tú ti usted ustedes vosotros vuestro").split()
FEATURES = ["words", "chars", "density", "hits", "weight", "strongest", "near_second", "second", "capitals",
            "shouted", "punctuation", "exclamation", "obfuscated", "hidden_hits", "stretched"]

LOOKALIKE = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"013457@$!", b"oieastasi"):
    LOOKALIKE[_sign] = _letter
IS_LETTER = ~W.LETTER_GAP
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_POINT = np.zeros(256, bool)
IS_POINT[33:48] = IS_POINT[58:65] = IS_POINT[91:97] = IS_POINT[123:127] = True
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[ord(c) for c in "0123456789@$!*#"]] = True

Lexicon = tuple[np.ndarray, np.ndarray]  # sorted hashes, weights


def _entries(part: W.Letters):
    """(hashes, word numbers) of whole words and of each kind of beginning."""
    yield part.words(), np.arange(len(part.rows))
    for size in PREFIXES:
        yield part.prefixes(size)


def _presence(batches):
    """(hash, fold, toxic, clean): in how many of a batch's documents each entry occurs."""
    for batch in batches:
        data, offsets = W.texts_of(batch.column(0))
        fold, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
        for a, b in W.parts(offsets):
            o = offsets[a:b + 1]
            part = W.Letters(data[o[0]:o[-1]], o - o[0])
            h, row = (np.concatenate(x) for x in zip(*((h, part.rows[w]) for h, w in _entries(part))))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[once], row[once] + a
            keys, at = np.unique(h, return_inverse=True)
            for f in (0, 1):
                bad = np.bincount(at[(fold[row] == f) & (toxic[row] == 1)], minlength=len(keys))
                good = np.bincount(at[(fold[row] == f) & (toxic[row] == 0)], minlength=len(keys))
                seen = (bad + good) > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[seen].view(np.int64)), pa.array(np.full(seen.sum(), f, np.int32)),
                     pa.array(bad[seen]), pa.array(good[seen])], ["h", "fold", "toxic", "clean"])


def _lexicon(counts: DataFrame, folds: tuple[int, ...], bad: dict, good: dict) -> Lexicon:
    """Entries of the given folds with enough toxic documents and log odds; at most ``MOST_ENTRIES``."""
    sums = counts.filter(F.col("fold").isin(*folds)).groupBy("h").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    n_bad, n_good = (sum(x.get(f, 0) for f in folds) for x in (bad, good))
    odds = F.log((F.col("t") + 0.5) / (n_bad + 1)) - F.log((F.col("c") + 0.5) / (n_good + 1))
    top = (sums.filter(F.col("t") >= LEAST_TOXIC).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
           .orderBy(F.desc("odds"), F.desc("t"), "h").limit(MOST_ENTRIES).select("h", "odds").collect())
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r["odds"] for r in top], float)[order]


def _word_weights(part: W.Letters, lexicon: Lexicon) -> np.ndarray:
    weight = np.zeros(len(part.rows))
    for h, word in _entries(part):
        at, hit = W.place(lexicon[0], h)
        np.maximum.at(weight, word[hit], lexicon[1][at[hit]])
    return weight


def _by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


_YOU = np.array([w.encode() for w in SECOND_PERSON], object)


def _second_person() -> np.ndarray:
    data = np.frombuffer(b" ".join(_YOU), np.uint8)
    starts, lengths, _ = W.spans(data, np.array([0, len(data)]))
    return np.sort(W.salted(W.hash_spans(data, starts, lengths), 0))


def dense(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(rows, FEATURES) of a part's texts."""
    rows = len(offsets) - 1
    part = W.Letters(data, offsets)
    bounds = np.searchsorted(part.rows, np.arange(rows + 1))
    words = np.maximum(np.diff(bounds), 1)
    size = np.diff(offsets)
    chars = np.maximum(size, 1)
    weight = _word_weights(part, lexicon)
    hit = weight > 0
    strongest = np.zeros(rows)
    np.maximum.at(strongest, part.rows[hit], weight[hit])
    you = W.place(_second_person(), part.words())[1]
    seen = np.concatenate([[0], np.cumsum(you)])
    number = np.arange(len(part.rows))
    near = seen[np.minimum(number + NEAR + 1, bounds[part.rows + 1])] > seen[np.maximum(number - NEAR, bounds[part.rows])]
    letter = IS_LETTER[data]
    upper, sign = IS_UPPER[data], IS_SIGN[data]
    inside = np.zeros(len(data), bool)
    stretched = np.zeros(len(data), bool)
    if len(data) > 2:
        inside[1:-1] = sign[1:-1] & letter[:-2] & letter[2:]
        stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    raised = np.concatenate([[0], np.cumsum(upper)])
    shouted = (part.lengths >= 3) & (raised[part.starts + part.lengths] - raised[part.starts] == part.lengths)
    hits = _by_row(hit, bounds)
    clear = W.Letters(LOOKALIKE[data], offsets)
    hidden = np.bincount(clear.rows[_word_weights(clear, lexicon) > 0], minlength=rows)[:rows]
    letters = np.maximum(_by_row(letter, offsets), 1)
    return np.stack([
        np.log1p(np.diff(bounds)), np.log1p(size), hits / words, np.log1p(hits), _by_row(weight, bounds) / words,
        strongest, _by_row(hit & near, bounds) / words, _by_row(you, bounds) / words, _by_row(upper, offsets) / letters,
        _by_row(shouted, bounds) / words, _by_row(IS_POINT[data], offsets) / chars, _by_row(data == 33, offsets) / chars,
        _by_row(inside, offsets) / words, np.maximum(hidden - hits, 0) / words, _by_row(stretched, offsets) / chars], 1)


def _featured(docs: DataFrame, keep: list[str], lexicons: list[Lexicon], which: str | None = None) -> DataFrame:
    """The columns ``keep`` and the features; ``which`` names the column that picks the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches):
        for batch in batches:
            data, offsets = W.texts_of(batch.column(batch.num_columns - 1))
            made = [np.zeros((0, len(FEATURES)))]
            pick = batch.column(batch.schema.names.index(which)).to_numpy(zero_copy_only=False) if which else None
            for a, b in W.parts(offsets):
                o = offsets[a:b + 1]
                body = data[o[0]:o[-1]], o - o[0]
                each = [dense(*body, x) for x in shared.value]
                made.append(np.choose(pick[a:b, None].astype(int), each) if which else each[0])
            table = np.concatenate(made)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(table[:, i]) for i in range(len(FEATURES))]],
                                             [*batch.schema.names[:-1], *FEATURES])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, schema + "".join(f", `{x}` double" for x in FEATURES))


def score(docs: DataFrame, labels: DataFrame, most_rows: int = 30_000, trees: int = 20, depth: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of the held-out third are not used."""
    held = remainder("doc_id", 3) == 1
    source = docs.select(F.col("doc_id"), held.alias("held_out"), "text")
    known = (labels.select("doc_id", "toxic").dropna().filter(~held)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = known.count()
    share = min(1.0, most_rows / max(total, 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1e6)
    known = known.limit(2 * most_rows)  # never met: bounds the broadcast
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10))
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "doc_id", "toxic", F.pmod(part, F.lit(2)).cast("int").alias("fold"), (part >= 8).alias("calibrate"), "text")
    train = cut_lineage(train)
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in train.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad = {f: sizes.get((f, 1), 0) for f in (0, 1)}
    good = {f: sizes.get((f, 0), 0) for f in (0, 1)}
    n_bad, n_good = sum(bad.values()), sum(good.values())
    plain = F.lit(n_bad / (n_bad + n_good) if n_bad else 0.0)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    if not n_bad or not n_good:
        return source.select("doc_id", "held_out", plain.alias("score")).select("*", predicted)

    counts = cut_lineage(train.select("text", "fold", "toxic").mapInArrow(
        _presence, "h long, fold int, toxic long, clean long").groupBy("h", "fold").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    crossed = [_lexicon(counts, (1,), bad, good), _lexicon(counts, (0,), bad, good)]
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = cut_lineage(_featured(train, ["toxic", "fold", "calibrate"], crossed, "fold"))
    rows = vectors.transform(rows.withColumn("label", F.col("toxic").cast("double")))
    fit, check = rows.filter("NOT calibrate"), rows.filter("calibrate")
    if fit.select("label").distinct().count() < 2 or check.isEmpty():
        fit = check = rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, minInstancesPerNode=5).fit(fit)
    raw = vector_to_array("probability")[1]
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
        model.transform(check).select("label", raw.alias("raw")))
    lexicon = _lexicon(counts, (0, 1), bad, good)
    scored = model.transform(vectors.transform(_featured(source, ["doc_id", "held_out"], [lexicon])))
    scored = curve.transform(scored.select("doc_id", "held_out", raw.alias("raw")))
    return scored.select("doc_id", "held_out", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"), "raw").select(
        "doc_id", "held_out", "score", predicted, "raw")
