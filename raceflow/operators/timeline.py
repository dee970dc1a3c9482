"""Per-entity history: what was known before each row.

Features are described by ``Spec`` values and evaluated together, so that any
number of them costs one shuffle and one sort per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.session import ship_package

@dataclass
class Spec:
    """Running sums (``totals``), bounded frames, and columns computed from both in
    stages (``derived``, ``refined``, ``final``). Names starting with ``_`` are dropped."""

    totals: dict[str, Column] = field(default_factory=dict)
    frames: dict[str, Callable] = field(default_factory=dict)
    lookback: int = 0
    derived: dict[str, Column] = field(default_factory=dict)
    refined: dict[str, Column] = field(default_factory=dict)
    final: dict[str, Column] = field(default_factory=dict)

    def __add__(self, other: Spec) -> Spec:
        return Spec({**self.totals, **other.totals}, {**self.frames, **other.frames},
                    max(self.lookback, other.lookback), {**self.derived, **other.derived},
                    {**self.refined, **other.refined}, {**self.final, **other.final})


def start_count(name: str = "career_starts") -> Spec:
    """Number of earlier rows of the entity."""
    return Spec(totals={name: F.lit(1)}, derived={name: F.col(name).cast("long")})


def prior_sum(name: str, value: Column) -> Spec:
    """Sum of ``value`` over earlier rows, 0 when there are none."""
    return Spec(totals={name: F.coalesce(value, F.lit(0))})


def prior_rate(name: str, hit: Column) -> Spec:
    """Share of earlier rows with ``hit`` = 1; NULL for a first start."""
    return Spec(totals={f"_{name}_n": F.lit(1), f"_{name}_hits": hit},
                derived={name: F.try_divide(F.col(f"_{name}_hits"), F.col(f"_{name}_n"))})


def rolling(columns: Sequence[str], windows: Sequence[int], aggs: Sequence[str]) -> Spec:
    """``past_{w}_{column}_{agg}`` over the last ``w`` rows before this one, NULLs and NaNs ignored.

    The last max(windows) values of a column are as many lags on the shared sort; every window and
    aggregate is then worked out of them for a whole Arrow batch at a time. A sliding frame per
    (window, aggregate) would re-aggregate each row many times over.
    """
    unknown = set(aggs) - set(_OF_VALUES)
    if unknown:
        raise ValueError(f"unsupported aggregates {sorted(unknown)}")
    depth = max(windows)
    spec = Spec(lookback=depth)
    made = [(w, a) for w in windows for a in aggs]
    summary = F.arrow_udf(_summaries(windows, made), ", ".join(
        f"`{w}_{a}` {'int' if a == 'count' else 'double'}" for w, a in made))
    for c in columns:
        lags = [f"_lag_{j}_{c}" for j in range(depth, 0, -1)]
        for j, lag in zip(range(depth, 0, -1), lags):
            spec.frames[lag] = lambda over, c=c, j=j: F.lag(F.col(c).cast("double"), j).over(over)
        spec.derived[f"_past_{c}"] = summary(*lags)
        for w, a in made:
            spec.final[f"past_{w}_{c}_{a}"] = F.col(f"_past_{c}")[f"{w}_{a}"]
    return spec


def _summaries(windows: Sequence[int], made: Sequence[tuple[int, str]]) -> Callable:
    """A function of the last values, oldest first, giving a struct of the aggregates ``made``."""
    def summaries(*lags: pa.Array) -> pa.Array:
        values = np.column_stack([x.to_numpy(zero_copy_only=False).astype(float, copy=False) for x in lags])
        found = {}
        with np.errstate(invalid="ignore", over="ignore"):
            for w in windows:
                held = np.sort(values[:, -w:], axis=1)  # NaN, which stands for NULL too, goes last
                n = np.count_nonzero(~np.isnan(held), axis=1)
                found.update({(w, a): f(held, n) for a, f in _OF_VALUES.items() if (w, a) in made})
        return pa.StructArray.from_arrays([found[x] for x in made], names=[f"{w}_{a}" for w, a in made])
    return summaries


def _total(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first ``n`` of every row, smallest first."""
    total = np.zeros(len(values))
    for j in range(values.shape[1]):
        total = np.where(j < n, total + values[:, j], total)
    return total


def _at(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    return values[np.arange(len(values)), np.maximum(place, 0)]


def _std(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    gaps = values - (_total(values, n) / np.maximum(n, 1))[:, None]
    return np.sqrt(_total(gaps * gaps, n) / np.maximum(n - 1, 1))


# (sorted values, how many) → an aggregate a row; NULL where there are none
_OF_VALUES = {
    "mean": lambda v, n: pa.array(_total(v, n) / np.maximum(n, 1), mask=n < 1),
    "median": lambda v, n: pa.array((_at(v, (n - 1) // 2) + _at(v, n // 2)) / 2, mask=n < 1),
    "std": lambda v, n: pa.array(_std(v, n), mask=n < 2),
    "max": lambda v, n: pa.array(_at(v, n - 1), mask=n < 1),
    "min": lambda v, n: pa.array(_at(v, n * 0), mask=n < 1),
    "sum": lambda v, n: pa.array(_total(v, n), mask=n < 1),
    "count": lambda v, n: pa.array(n, pa.int32()),
}


def previous(columns: Sequence[str]) -> Spec:
    """``prev_c`` and ``is_c_changed``; a current NULL after a value counts as changed."""
    def lag(column):
        return lambda over: F.lag(column, 1).over(over)

    changed = {
        f"is_{c}_changed": F.when(F.col(f"prev_{c}").isNotNull()
                                  & ~F.col(c).eqNullSafe(F.col(f"prev_{c}")), 1).otherwise(0)
        for c in columns
    }
    return Spec(frames={f"prev_{c}": lag(c) for c in columns}, lookback=1, derived=changed)


def days_since_previous(day: str, name: str = "days_since_last_race") -> Spec:
    return Spec(frames={name: lambda over: F.datediff(F.col(day), F.lag(day, 1).over(over))}, lookback=1)


def with_history(df: DataFrame, entity: Sequence[str], order, *specs: Spec, hot=None) -> DataFrame:
    """Evaluate all ``specs`` over each entity's rows in ``order``. Rolling aggregates run in Python workers, which
    are handed the package."""
    ship_package(df.sparkSession)
    spec = sum(specs, Spec())
    out = skew.history(df, entity, order, spec.totals, spec.frames, spec.lookback, hot)
    for stage in (spec.derived, spec.refined, spec.final):
        if stage:
            out = out.withColumns(stage)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def last_rows(df: DataFrame, entity: Sequence[str], order, n: int, position: str = "_r") -> DataFrame:
    """The newest ``n`` rows per entity, numbered from the newest. The limit is
    applied before the shuffle, so a busy entity sends ``n`` rows per task."""
    w = Window.partitionBy(*entity).orderBy(*skew._sort(order, reverse=True))
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= n)


def recent_summary(df: DataFrame, entity: str, order, windows: Sequence[int],
                   finish: str = "finish_position") -> DataFrame:
    """Per entity, over its last w rows: mean finish, win rate, share in the first two."""
    recent = last_rows(df.select(entity, finish, *_names(order)), [entity], order, max(windows))
    y = F.col(finish)
    aggs = []
    for w in windows:
        inside = F.col("_r") <= w
        aggs += [
            F.avg(F.when(inside, y)).alias(f"avg_finish_last{w}"),
            F.avg(F.when(inside, F.coalesce((y == 1).cast("int"), F.lit(0)))).alias(f"win_rate_last{w}"),
            F.avg(F.when(inside, F.coalesce((y <= 2).cast("int"), F.lit(0)))).alias(f"place_rate_last{w}"),
        ]
    return recent.groupBy(entity).agg(*aggs)


def improvement_rate(df: DataFrame, entity: str, order, windows: Sequence[int],
                     finish: str = "finish_position") -> DataFrame:
    """(mean of the first half − mean of the last half) / first, over the last w rows;
    needs two rows."""
    recent = last_rows(df.select(entity, finish, *_names(order)), [entity], order, max(windows))
    recent = recent.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(entity)))
    aggs = []
    for w in windows:
        half, size = w // 2, F.least(F.col("_n"), F.lit(w))
        first = F.avg(F.when((F.col("_r") <= w) & (F.col("_r") > size - half), F.col(finish)))
        second = F.avg(F.when(F.col("_r") <= half, F.col(finish)))
        aggs.append(F.when(F.max("_n") >= 2, F.try_divide(first - second, first)).alias(f"improvement_rate_{w}"))
    return recent.groupBy(entity).agg(*aggs)


def form_state(df: DataFrame, entity: str, order, finish: str = "finish_position") -> DataFrame:
    """Latest change of the 3-row rolling mean: improving / declining / stable; ≥ 5 rows."""
    recent = last_rows(df.select(entity, finish, *_names(order)), [entity], order, 5)
    r, y = F.col("_r"), F.col(finish)
    change = F.avg(F.when(r <= 3, y)) - F.avg(F.when(r.between(2, 4), y))
    return (
        recent.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"), change.alias("form_derivative"))
        .filter(F.col("_n") >= 5).drop("_n")
        .withColumn("form_state", F.when(F.col("form_derivative") < -0.5, "improving")
                    .when(F.col("form_derivative") > 0.5, "declining").otherwise("stable"))
    )


def growth_curve(df: DataFrame, entity: str, order, finish: str = "finish_position",
                 age: str = "age", max_age: int = 3, min_starts: int = 3, hot=None) -> DataFrame:
    """Slope of finish on start index and the spread around that line, for entities
    seen at ``age`` ≤ ``max_age``."""
    rows = skew.row_numbers(df.select(entity, finish, age, *_names(order)), [entity], order, "_i", hot)
    x, y = F.col("_i") - 1, F.col(finish)
    return (
        rows.groupBy(entity).agg(
            F.count(F.lit(1)).alias("starts"), F.min(age).alias("_age"),
            F.regr_slope(y, x).alias("growth_slope"),
            F.sqrt(F.greatest(F.regr_syy(y, x) * (1 - F.regr_r2(y, x)), F.lit(0.0)) / F.count(y))
            .alias("growth_stability"))
        .filter((F.col("_age") <= max_age) & (F.col("starts") >= min_starts)).drop("_age")
    )


def before_day(df: DataFrame, entity: str, day: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over rows of the entity on strictly earlier days.

    Rows are first combined per (entity, day): a busy entity then has at most one
    row per calendar day, which bounds the running window.
    """
    daily = df.groupBy(entity, day).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    earlier = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    prior = daily.select(entity, day, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums])
    return skew.attach(df, prior, [entity, day])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, columns: Sequence[str],
          tie: Sequence[str] = (), tolerance: Column | None = None, strict: bool = False, hot=None) -> DataFrame:
    """``left`` with ``columns`` (and ``right_time``) of the newest row of ``right`` of the same keys that is
    not later than the row's ``time`` (earlier, if ``strict``).

    A slowly changing table is looked up without a range join: both sides are laid on one timeline per
    key and the last right row is carried forward, in one shuffle; hot keys are cut into range chunks.
    Of right rows of one key and time the largest by ``tie`` counts, then by ``columns``. ``tolerance``
    is an interval, or a number for numeric times: a row that is older by more is no match. NULL keys
    and times match nothing; every left row stays, once.
    """
    own = [f"_l_{c}" for c in left.columns]
    known = right.filter(F.col(right_time).isNotNull())
    for k in keys:
        known = known.filter(F.col(k).isNotNull())
    newest = F.max(F.struct(*[F.col(c) for c in [*tie, *columns]])).alias("_m")
    known = known.groupBy(*keys, right_time).agg(newest).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(right_time).alias("_t"),
        F.struct(F.col(right_time).alias("_t"), *[F.col(f"_m.{c}").alias(c) for c in columns]).alias("_right"))
    asked = left.select(*[F.col(c).alias(o) for c, o in zip(left.columns, own)], *[F.col(k).alias(f"_k_{k}") for k in keys],
                        F.col(time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.monotonically_increasing_id().alias("_id"))
    both = asked.unionByName(known.withColumns({"_side": F.lit(1 if strict else 0), "_id": F.lit(-1).cast("long")}), allowMissingColumns=True)
    order = ["_t", "_side", "_id"]
    line = skew.carry_forward(both, [f"_k_{k}" for k in keys], order, F.col("_right"), "_found", hot)
    fits = F.col("_t").isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("_found._t") + tolerance >= F.col("_t"))
    found = F.when(fits, F.col("_found"))
    return line.filter("_id >= 0").select(
        *[F.col(o).alias(c) for c, o in zip(left.columns, own)],
        found["_t"].alias(right_time), *[found[c].alias(c) for c in columns])


def _names(order) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order]
