"""A scorer of whole finishing orders: conditional logit over what is left of the field.

The first of a race is chosen among all its runners, the second among the others, and
so on; a runner's chance of being chosen is its exp(score) over the sum of those of the
runners left. Scores are linear in the standardised features. The likelihood is concave,
so a few Newton steps find its maximum; a step is one pass that needs, per row, sums over
the runners behind it, and returns one row of sums to the driver.

A null feature counts as the column's mean, a constant column gets weight 0, rows without
a place have no part in the fit, and races of one runner add nothing to it. Ties have to
be broken by further columns of ``order``. An empty table gives weights of 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.session import cut_lineage

MOST_FEATURES = 40  # a pass carries some n² / 2 running sums


@dataclass(frozen=True)
class Listwise:
    columns: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    weights: tuple[float, ...]
    log_likelihood: float
    steps: int

    def score(self) -> Column:
        """The score of a row; larger is better."""
        out = F.lit(0.0)
        for z, w in zip(_standard(self.columns, self.means, self.spreads), self.weights):
            out = out + z * F.lit(w)
        return out


def _standard(columns: Sequence[str], means: Sequence[float], spreads: Sequence[float]) -> list[Column]:
    return [F.coalesce((F.col(c).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) if s > 0 else F.lit(0.0)
            for c, m, s in zip(columns, means, spreads)]


def _shapes(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    values = [F.col(c).cast("double") for c in columns]
    row = df.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    found = [0.0 if v is None else float(v) for v in row]
    return found[:len(columns)], found[len(columns):]


def likelihood_sums(rows: DataFrame, group: str, order: Sequence, z: Sequence[str], weights: Sequence[float], hot=None):
    """(log-likelihood, gradient, information) of ``weights`` over ``rows``, whose columns ``z`` hold no nulls.

    Rows are run through from the last place to the first, so that the sums over earlier rows are those
    over the runners behind; the sums over hot races are made in range chunks.
    """
    n = len(z)
    pairs = [(k, m) for k in range(n) for m in range(k, n)]
    reverse = [(o, False) if isinstance(o, str) else (o[0], not o[1]) for o in order]
    score = F.lit(0.0)
    for c, w in zip(z, weights):
        score = score + F.col(c) * F.lit(float(w))

    def work(part: DataFrame, hot) -> DataFrame:
        part = part.withColumn("_score", score)
        part = skew.over_group(part, [group], {"_top": F.max("_score")}, hot)
        # far below the best runner a term is held at a floor that is still a number
        part = part.withColumn("_e", F.exp(F.greatest(F.col("_score") - F.col("_top"), F.lit(-300.0))))
        e = F.col("_e")
        totals = {"_a": e, **{f"_b{k}": e * F.col(z[k]) for k in range(n)},
                  **{f"_c{k}_{m}": e * F.col(z[k]) * F.col(z[m]) for k, m in pairs}}
        part = skew.history(part, [group], reverse, totals=totals, hot=hot)
        left = {name: F.col(name) + own for name, own in totals.items()}
        mean = [left[f"_b{k}"] / left["_a"] for k in range(n)]
        return part.select(
            (F.col("_score") - F.col("_top") - F.ln(left["_a"])).alias("ll"),
            *[(F.col(z[k]) - mean[k]).alias(f"g{k}") for k in range(n)],
            *[(left[f"_c{k}_{m}"] / left["_a"] - mean[k] * mean[m]).alias(f"h{k}_{m}") for k, m in pairs])

    terms = skew.by_part(rows, [group], hot, work)
    row = terms.agg(*[F.sum(c).alias(c) for c in terms.columns]).first()
    found = [0.0 if v is None else float(v) for v in row]
    information = np.zeros((n, n))
    for (k, m), value in zip(pairs, found[1 + n:]):
        information[k, m] = information[m, k] = value
    return found[0], np.array(found[1:1 + n]), information


def fit(df: DataFrame, group: str, order: Sequence, columns: Sequence[str], most_steps: int = 20,
        tolerance: float = 1e-10, ridge: float = 0.0, hot=None) -> Listwise:
    """Newton steps from zero until the expected gain falls below ``tolerance`` a row; a step that loses is halved.

    ``order`` is the finishing order, best first (columns or (column, ascending)), unique per race.
    ``ridge`` is taken off the log-likelihood as ridge / 2 · |weights|².
    """
    if len(columns) > MOST_FEATURES:
        raise ValueError(f"{len(columns)} features; a pass carries the sums of at most {MOST_FEATURES}")
    place = order[0] if isinstance(order[0], str) else order[0][0]
    names = [o if isinstance(o, str) else o[0] for o in order]
    df = df.filter(F.col(place).isNotNull())
    means, spreads = _shapes(df, columns)
    z = [f"_z{k}" for k in range(len(columns))]
    rows = cut_lineage(df.select(group, *[c for c in names if c != group],
                                 *[x.alias(c) for c, x in zip(z, _standard(columns, means, spreads))]))
    if hot is None:
        hot = skew.hot_keys(rows, [group])
    count = max(rows.count(), 1)

    def at(w):
        ll, g, h = likelihood_sums(rows, group, order, z, w, hot)
        return ll - ridge / 2 * float(w @ w), g - ridge * w, h + ridge * np.eye(len(w))

    weights = np.zeros(len(columns))
    best, gradient, information = at(weights)
    steps = 0
    for steps in range(1, most_steps + 1):
        # columns that are constant or sums of others leave directions without information: least norm
        move = np.linalg.pinv(information, rcond=1e-10, hermitian=True) @ gradient
        gain = float(gradient @ move) / 2
        if gain < tolerance * count:  # the last step is taken without another pass
            weights, best = weights + move, best + gain
            break
        found = at(weights + move)
        while found[0] < best and np.abs(move).max() > 1e-9:
            move = move / 2
            found = at(weights + move)
        if found[0] < best:
            break
        weights, (best, gradient, information) = weights + move, found
    return Listwise(tuple(columns), tuple(means), tuple(spreads), tuple(float(w) for w in weights), best, steps)


def chances(df: DataFrame, group: str, score: str, out: str = "win_chance", hot=None) -> DataFrame:
    """Each runner's chance of being first: exp(score) over the sum in its race; a null score has no chance."""
    def work(part: DataFrame, hot) -> DataFrame:
        part = skew.over_group(part, [group], {"_top": F.max(score)}, hot)
        part = part.withColumn("_e", F.coalesce(F.exp(F.col(score) - F.col("_top")), F.lit(0.0)))
        part = skew.over_group(part, [group], {"_sum": F.sum("_e")}, hot)
        return part.withColumn(out, F.try_divide(F.col("_e"), F.col("_sum"))).drop("_top", "_e", "_sum")

    return skew.by_part(df, [group], hot, work)
