"""Language identification by word-first backoff.

A word seen in training votes with its log frequency in every language. An unseen word
votes with the mean log frequency of its known character 5-grams, else of its 4-grams,
and so on down to single characters. Votes are summed over the whole text; the score is
the posterior of the best language under equal priors.

The model is fitted on a bounded sample of labelled rows (``per_lang`` documents of each
language, chosen by a hash of the id) and keeps the ``max_words`` most frequent words and
``max_grams`` n-grams of each length; these bounds are parameters. Every text is scored
in whole. Words are runs of letters: A-Z and a-z (lower-cased) and all bytes of
characters beyond ASCII.

Null texts and texts without a letter are ``und`` with score 0; with nothing learned
every text is. Ties go to the language that sorts first. Repeated rows are scored each.
An empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raceflow.llm import words as W
from raceflow.llm.rows import remainder

ORDERS = (5, 4, 3, 2, 1)
PART_BYTES = 1 << 18  # bytes of text whose n-grams are held at a time; some 100 bytes of memory for each
WORD = 0
SMOOTH = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    keys: dict[int, np.ndarray]  # order → sorted hashes
    weights: dict[int, np.ndarray]  # order → (languages, keys) log frequencies


def _counted(batches, languages: list[str]):
    """Rows (kind, lang, hash, n) of the words and n-grams of labelled texts."""
    index = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        data, offsets = W.texts_of(batch.column(1))
        lang = np.array([index[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
        for a, b in W.parts(offsets, PART_BYTES):
            o = offsets[a:b + 1]
            part = W.Letters(data[o[0]:o[-1]], o - o[0])
            of = lang[a:b][part.rows]
            every = np.arange(len(of))
            for order in (WORD, *ORDERS):
                h, word = (part.words(), every) if order == WORD else part.grams(every, order)
                for i in range(len(languages)):
                    key, n = np.unique(h[of[word] == i], return_counts=True)
                    if len(key):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), order, np.int32)), pa.array(np.full(len(key), i, np.int32)),
                             pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "lang", "h", "n"])


def learn(labelled: DataFrame, per_lang: int = 3_000, max_words: int = 40_000, max_grams: int = 20_000) -> Model:
    """``labelled``: doc_id, text, lang (rows with a null text or lang teach nothing)."""
    labelled = labelled.select("doc_id", "text", "lang").dropna(subset=["text", "lang"])
    found = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(found)  # a row per language
    if not languages:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for lang, n in found.items() for x in (lang, min(1.0, per_lang / n))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1e6)
    rows = sample.select("lang", "text").mapInArrow(lambda b: _counted(b, languages), "kind int, lang int, h long, n long")
    each = rows.groupBy("kind", "h").agg(*[F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}")
                                           for i in range(len(languages))])
    total = sum(F.col(f"n{i}") for i in range(len(languages)))
    sums = Window.partitionBy("kind")
    top = sums.orderBy(F.desc("all"), "h")
    each = each.withColumn("all", total)
    totals = each.groupBy("kind").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))],
                                      F.count(F.lit(1)).alias("kinds"))
    limit = F.when(F.col("kind") == WORD, max_words).otherwise(max_grams)
    best = (each.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= max(max_words, max_grams))
            .filter(F.col("rank") <= limit).drop("rank", "all"))
    sizes = {r["kind"]: r for r in totals.collect()}
    table = best.toArrow()  # at most max_words + 5 * max_grams rows
    kinds = table["kind"].to_numpy()
    keys, weights = {}, {}
    for kind, size in sizes.items():
        own = table.filter(pa.array(kinds == kind))
        h = own["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        keys[kind] = h[order]
        counts = np.stack([own[f"n{i}"].to_numpy().astype(float) for i in range(len(languages))], axis=1)[order]
        mass = np.array([size[f"n{i}"] for i in range(len(languages))], float) + SMOOTH * size["kinds"]
        weights[kind] = np.log((counts + SMOOTH) / mass).T.astype(np.float32).copy()
    return Model(languages, keys, weights)


def _votes(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages) sums of log frequencies, and the words of each row."""
    part = W.Letters(data, offsets)
    many = len(offsets) - 1
    votes = np.zeros((many, len(model.languages)))
    empty = np.zeros(0, np.uint64)
    at, known = W.place(model.keys.get(WORD, empty), part.words())
    for i in range(len(model.languages)):
        votes[:, i] += np.bincount(part.rows[known], model.weights[WORD][i][at[known]], many) if known.any() else 0
    left = np.flatnonzero(~known)
    for order in ORDERS:
        if not len(left) or order not in model.keys:
            continue
        h, word = part.grams(left, order)
        at, known = W.place(model.keys[order], h)
        word, at = word[known], at[known]
        hits = np.bincount(word, minlength=len(part.rows))
        for i in range(len(model.languages)):
            votes[:, i] += np.bincount(part.rows[word], model.weights[order][i][at] / hits[word], many)
        left = left[hits[left] == 0]
    return votes, np.bincount(part.rows, minlength=many)


def guess(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of an Arrow column."""
    data, offsets = W.texts_of(column)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    names, scores = [], []
    for a, b in W.parts(offsets, PART_BYTES):
        o = offsets[a:b + 1]
        own, local = data[o[0]:o[-1]], o - o[0]
        if model.languages:
            votes, words = _votes(own, local, model)
        else:
            votes, words = np.zeros((b - a, 1)), np.zeros(b - a, np.int64)
        letters = np.concatenate([[0], np.cumsum(ascii_letter[own])])
        plain = letters[local[1:]] - letters[local[:-1]]
        best = votes.argmax(axis=1)
        score = 1 / np.exp(votes - votes.max(axis=1, keepdims=True)).sum(axis=1)
        for i in range(b - a):
            ok = words[i] > 0 and (plain[i] > 0 or any(c.isalpha() for c in column[a + i].as_py()))
            names.append(model.languages[best[i]] if ok else UNKNOWN)
            scores.append(float(score[i]) if ok else 0.0)
    return names, np.array(scores, float)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = guess(batch.column(batch.num_columns - 1), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)],
                                             [*batch.schema.names[:-1], "lang_pred", "score"])

    source = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The contract's columns: learned from the documents outside fold 0, predicted for all."""
    held = remainder("doc_id", folds) == 0
    model = learn(docs.filter(~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (unchanged) whose language is known with a score of ``least`` or more."""
    model = learn(docs.filter(remainder("doc_id", 5) != 0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            names, scores = guess(batch.column(at), shared.value)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
