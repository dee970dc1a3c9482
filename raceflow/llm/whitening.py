"""Whitening of embeddings with a weighted multiplicity covariance.

1. Identical integer vectors x are grouped (a map-side combine); each is a row of the fit list
   with its multiplicity.
2. Sums S and n are exact. A vector counts with its multiplicity (``weight="count"``) or
   once (``"one"``). x is centred in integers, n * x - S, and only then turned to double;
   tasks multiply their centred block by itself (one GEMM a batch) and the d x d partial
   products are added by row.
3. The d x d covariance, which the dimension bounds and not the data, is decomposed on the
   driver: unit eigenvectors by falling eigenvalue, the largest entry positive.
4. Each distinct vector is whitened once and stored; rows get theirs by a join on x, with
   vectors of many rows broadcast (fewer than 1,000).
5. ``identity_error`` is measured, not derived: a second centred product over the whitened
   fit list, whose block means are merged pairwise.

Rows whose vector is null or holds null, NaN or infinite entries are left out. Entries beyond
2**56 count as 2**56 before they are scaled. A null or repeated vec_id is a row like any other.
Vectors of different lengths are fitted each on their own; those of length 0 have no
components. A component whose eigenvalue is not above rounding (fewer distinct vectors
than dimensions, equal entries) has ``whitened`` null and no part in ``identity_error``,
which is null if there is no other. ``explained`` is null if the trace is 0. ``deviation`` is
null where a long cannot hold it; ``deviation_text`` then has its digits. An
empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow.llm.rows import join_hot
from raceflow.session import cut_lineage

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 56)
BLOCK = 8_192  # vectors of a product


def integers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the rows with a whole, finite vector."""
    entry = F.col(vector).cast("array<double>")
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entry, lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST)), F.lit(-MOST)) * SCALE) + SHIFT)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _blocks(batches, dim: int):
    """(x as a matrix, weights) of at most ``BLOCK`` vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column(0), dim), part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double, rounded once: the whole part of the mean is taken off in integers."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum of (n * x - S)^2 of each row."""
    whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
    d = x - whole
    if len(d) == 0 or (n * (int(np.abs(d).max()) + 1)) ** 2 * max(1, d.shape[1]) < 1 << 62:
        return ((d * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, rest)) for row in d.tolist()]


def _sums(batches, dim: int):
    """Exact sums of each dimension over a task's vectors (numbers of any size, so as text)."""
    total = [0] * dim
    for _, x, w in _blocks(batches, dim):
        if int(np.abs(x).max(initial=0)) * int(w.sum()) < 1 << 62:
            part = (x * w[:, None]).sum(axis=0).tolist()
        else:
            part = [sum(a * b for a, b in zip(column, w.tolist())) for column in x.T.tolist()]
        total = [a + b for a, b in zip(total, part)]
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total])], ["i", "s"])


def _product(batches, dim: int, n: int, sums: list[int]):
    """The rows of sum w (x - m)(x - m)' over a task's vectors."""
    total = np.zeros((dim, dim))
    for _, x, w in _blocks(batches, dim):
        c = centred(x, n, sums)
        total += (c * w[:, None]).T @ c
    yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])


def _whitened(batches, dim: int, n: int, sums: list[int], axes: np.ndarray, fine: np.ndarray):
    """Each distinct vector: x, multiplicity, whitened entries, deviation."""
    for part, x, _ in _blocks(batches, dim):
        z = centred(x, n, sums) @ axes
        entries = pa.array(z.reshape(-1), mask=np.broadcast_to(~fine, z.shape).reshape(-1))
        offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
        exact = deviations(x, n, sums)
        small = [e < 1 << 63 for e in exact]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(2), pa.ListArray.from_arrays(offsets, entries),
             pa.array([e if s else None for e, s in zip(exact, small)], pa.int64()),
             pa.array([None if s else str(e) for e, s in zip(exact, small)], pa.string())],
            ["x", "many", "z", "deviation", "deviation_text"])


def _spread(batches, size: int):
    """Weight, mean and centred product of a task's whitened vectors, blocks merged pairwise."""
    held = (0.0, np.zeros(size), np.zeros((size, size)))
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            z = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            w = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            mean = w @ z / w.sum()
            c = z - mean
            held = merged(held, (w.sum(), mean, (c * w[:, None]).T @ c))
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]),
                                          pa.array([held[2].reshape(-1).tolist()])], ["w", "mean", "product"])


def merged(a: tuple, b: tuple) -> tuple:
    """(weight, mean, centred product) of two blocks together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    w, gap = a[0] + b[0], b[1] - a[1]
    return w, a[1] + gap * (b[0] / w), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / w)


def _merged(batches, size: int):
    held = (0.0, np.zeros(size), np.zeros((size, size)))
    for batch in batches:
        for w, mean, product in zip(*(batch.column(i).to_pylist() for i in range(3))):
            held = merged(held, (w, np.array(mean), np.array(product).reshape(size, size)))
    if held[0]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1].tolist()]),
                                          pa.array([held[2].reshape(-1).tolist()])], ["w", "mean", "product"])


SPREAD = "w double, mean array<double>, product array<double>"


def covariance(fit: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, S and the covariance (divisor n) of ``fit`` (x, w; stored)."""
    n = int(fit.agg(F.sum("w")).first()[0])
    parts = fit.select("x", "w").mapInArrow(partial(_sums, dim=dim), "i int, s string")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(rows)]
    parts = fit.select("x", "w").mapInArrow(partial(_product, dim=dim, n=n, sums=sums), "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    made = np.zeros((dim, dim))
    for i, j, v in cells.collect():  # dim * dim numbers
        made[i, j] = v
    return n, sums, (made + made.T) / 2 / n


def axes_of(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), largest first, the largest entry of each positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def _whiten(rows: DataFrame, dim: int, weight: str, components: int) -> DataFrame:
    counted = F.col("many") if weight == "count" else F.lit(1).cast("long")
    distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("many"))
    distinct = cut_lineage(distinct.select("x", counted.alias("w"), "many"))
    n, sums, cov = covariance(distinct, dim)
    values, vectors = axes_of(cov, components)
    trace = float(np.trace(cov))
    fine = values > max(float(values[0]), 0.0) * dim * 1e-13
    scaled = vectors / np.sqrt(np.where(fine, values, 1.0))
    white = cut_lineage(distinct.mapInArrow(
        partial(_whitened, dim=dim, n=n, sums=sums, axes=scaled, fine=fine),
        "x array<bigint>, many long, z array<double>, deviation long, deviation_text string"))
    error, size = None, int(fine.sum())
    if size:
        fit = white.select(F.slice("z", 1, size).alias("z"), counted.alias("w"))
        parts = fit.mapInArrow(partial(_spread, size=size), SPREAD)
        w, _, product = parts.repartition(1).mapInArrow(partial(_merged, size=size), SPREAD).first()  # one row a task
        error = float(np.abs(np.array(product).reshape(size, size) / w - np.eye(size)).max())
    shares = [float(max(v, 0.0)) / trace if trace > 0 else None for v in values]
    matched = join_hot(rows, white, ["x"], "many", rows.count())
    return matched.select(
        "vec_id", F.posexplode("z").alias("at", "whitened"), "deviation", "deviation_text").select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_text")


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double, deviation_text string")


def whiten(vectors: DataFrame, vector: str = "embedding", weight: str = "one", components: int = COMPONENTS) -> DataFrame:
    """A row for every whole vector and component; ``weight`` is ``one`` or ``count``."""
    if weight not in ("one", "count"):
        raise ValueError("weight is one or count")
    rows = cut_lineage(integers(vectors, vector).select(F.col("vec_id").cast("long"), "x"))
    lengths = [r[0] for r in rows.select(F.size("x").alias("dim")).distinct().filter("dim > 0").orderBy("dim").collect()]
    whole = rows.sparkSession.createDataFrame([], RESULT)
    for dim in lengths:
        made = _whiten(rows.filter(F.size("x") == dim), dim, weight, min(components, dim))
        whole = made if len(lengths) == 1 else whole.unionByName(made)
    return whole
