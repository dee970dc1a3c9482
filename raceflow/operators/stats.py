"""Statistics of entities and combinations, attached to the rows that share the key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.operators.selection import template_name

AGGS: dict[str, Callable] = {
    "mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count,
    "median": lambda c: F.percentile(c, 0.5),
}
# Up to this many values of a context become columns; a wider one needs the long form or a list of values.
MAX_CONTEXTS = 500


def grouped(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Per-key aggregates; combined on the map side, so a hot key is no problem."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def entity_statistics(history: DataFrame, recipes: Sequence[Mapping]) -> dict[str, DataFrame]:
    """Recipes with id_column, target, agg and feature_name, one table per id column.

    All recipes on one id share a single aggregation; rows with a missing id or
    target do not count.
    """
    by_id: dict[str, list[Column]] = {}
    for r in recipes:
        if r["id_column"] in history.columns and r["target"] in history.columns:
            by_id.setdefault(r["id_column"], []).append(AGGS[r["agg"]](F.col(r["target"])).alias(r["feature_name"]))
    return {key: history.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs) for key, aggs in by_id.items()}


def context_values(history: DataFrame, column: str) -> list:
    """Distinct contexts, sorted; an error for a column with more than MAX_CONTEXTS values."""
    found = history.select(column).filter(F.col(column).isNotNull()).distinct().limit(MAX_CONTEXTS + 1).collect()
    if len(found) > MAX_CONTEXTS:
        raise ValueError(f"{column} has more than {MAX_CONTEXTS} values, too many for a column each: list the values wanted, "
                         "or use the long form (interaction_rows, one_hot_rows)")
    return sorted(r[0] for r in found)


def interaction_rows(history: DataFrame, recipes: Sequence[Mapping]) -> DataFrame:
    """The long form (recipe, id, context, value) of all ``recipes`` on one id column, in
    one aggregation whatever the number of contexts. ``recipe`` is the place in the list."""
    key = recipes[0]["id_column"]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("recipe"), F.col(r["context_column"]).cast("string").alias("context"),
                                        F.col(r["target"]).cast("double").alias("x")) for i, r in enumerate(recipes)])).alias("_e")
    cells = history.filter(F.col(key).isNotNull()).select(key, each).select(key, "_e.*").filter("context IS NOT NULL")
    aggs = sorted({r["agg"] for r in recipes})
    made = cells.groupBy(key, "recipe", "context").agg(*[AGGS[a]("x").alias(f"_{a}") for a in aggs])
    value = reduce(lambda rest, i: F.when(F.col("recipe") == i, F.col(f"_{recipes[i]['agg']}")).otherwise(rest),
                   range(len(recipes)), F.lit(None).cast("double"))
    return made.select(key, "recipe", "context", value.alias("value"))


def interaction_statistics(history: DataFrame, recipes: Sequence[Mapping],
                           values: Mapping[str, Sequence] | None = None) -> dict[str, DataFrame]:
    """Recipes with id_column, context_column, target, agg and feature_template: per id, the
    long form pivoted to a column for each listed context value. Contexts come from
    ``values`` or the recipe's ``values``, else from the data; a context with more than
    MAX_CONTEXTS values raises an error that names it (use ``interaction_rows``)."""
    values = dict(values or {})
    by_id: dict[str, list[Mapping]] = {}
    for r in recipes:
        if {r["id_column"], r["context_column"], r["target"]} <= set(history.columns):
            by_id.setdefault(r["id_column"], []).append(r)
            context = r["context_column"]
            if context not in values:
                values[context] = r.get("values") or context_values(history, context)
    out = {}
    for key, own in by_id.items():
        rows = interaction_rows(history, own)
        wide = [F.max(F.when((F.col("recipe") == i) & (F.col("context") == str(v)), F.col("value")))
                .alias(template_name(r["feature_template"], v)) for i, r in enumerate(own) for v in values[r["context_column"]]]
        if wide:
            out[key] = rows.groupBy(key).agg(*wide)
    return out


def strictly_before(df: DataFrame, history: DataFrame, keys: Sequence[str], day: str,
                    spec: Mapping[str, tuple[str, str]], least: int = 0, asked: DataFrame | None = None) -> DataFrame:
    """Attach per-key statistics (name → (mean | count | sum | std, column)) over the
    history of strictly earlier days; NULL below ``least`` rows. A key has one row per
    calendar day in the running window. NULL keys match each other. ``asked`` holds the keys
    and days of ``df``: give a stored table when several calls are chained."""
    asked = df if asked is None else asked
    columns = sorted({c for _, c in spec.values()})
    x = {c: F.col(c).cast("double") for c in columns}
    daily = history.groupBy(*keys, day).agg(*[a.alias(n) for i, c in enumerate(columns) for n, a in (
        (f"_n{i}", F.count(c)), (f"_s{i}", F.sum(x[c])), (f"_q{i}", F.sum(x[c] * x[c])))])
    parts = [f"_{p}{i}" for i in range(len(columns)) for p in "nsq"]
    days = asked.select(*keys, day).distinct().select(*keys, day, *[F.lit(0).cast("double").alias(p) for p in parts])
    every = daily.unionByName(days).groupBy(*keys, day).agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in parts])
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    sums = every.select(*keys, day, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in parts])

    def value(agg, i):
        n, s, q = (F.col(f"_{p}{i}") for p in "nsq")
        made = {"count": n.cast("long"), "sum": s, "mean": F.try_divide(s, n),
                "std": F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))}[agg]
        return F.when(n >= least, made) if least else made

    table = sums.select(*keys, day, *[value(agg, columns.index(c)).alias(name) for name, (agg, c) in spec.items()])
    return skew.attach(df, table, [*keys, day])


def attach_all(df: DataFrame, tables: Mapping[str, DataFrame], hot: Mapping | None = None) -> DataFrame:
    """Join each per-id table whose id the frame has."""
    found = {k: t for k, t in tables.items() if k in df.columns}
    for key, stored in zip(found, skew.stored_all(list(found.values()))):
        df = skew.lookup(df, stored, [key], (hot or {}).get(key), stored=True)
    return df


def entity_rate_before(df: DataFrame, entity: str, day: str, target: str, out: str) -> DataFrame:
    """Mean of ``target`` over the entity's rows on strictly earlier days (leakage-safe
    form of a mean entity statistic). One row per entity and day is windowed."""
    daily = df.filter(F.col(target).isNotNull()).groupBy(entity, day).agg(
        F.sum(target).alias("_s"), F.count(target).alias("_n"))
    # days on which the entity has rows but no target still need a value
    days = skew.attach(df.select(entity, day).distinct(), daily, [entity, day])
    earlier = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    prior = days.select(entity, day, F.try_divide(F.sum("_s").over(earlier), F.sum("_n").over(earlier)).alias(out))
    return skew.attach(df, prior, [entity, day])


def course_affinity(perf: DataFrame, entity: str, context: str, prefix: str,
                    extra: Mapping[str, str], finish: str = "finish_position") -> DataFrame:
    """Per entity and context: ``{prefix}_avg_finish``, ``{prefix}_races`` and means of
    the ``extra`` columns (name → column)."""
    return grouped(perf, [entity, context], {
        f"{prefix}_avg_finish": F.avg(finish), f"{prefix}_races": F.count(finish),
        **{n: F.avg(c) for n, c in extra.items()}})


def pair_synergy(perf: DataFrame, a: str, b: str, finish: str = "finish_position",
                 popularity: str = "popularity", odds: str | None = None) -> DataFrame:
    """Per pair: mean finish, starts, mean popularity, and how far it beats its popularity."""
    aggs = {"combo_avg_finish": F.avg(finish), "combo_races": F.count(finish),
            "combo_avg_popularity": F.avg(popularity)}
    if odds:
        aggs["combo_avg_odds"] = F.avg(odds)
    return grouped(perf, [a, b], aggs).withColumn(
        "combo_overperform", F.col("combo_avg_popularity") - F.col("combo_avg_finish"))


def sire_statistics(perf: DataFrame, sire: str, finish: str = "finish_position",
                    distance: str = "distance_m") -> DataFrame:
    return grouped(perf, [sire], {"sire_avg_finish": F.avg(finish), "sire_std_finish": F.stddev_samp(finish),
                                  "sire_avg_distance": F.avg(distance)})


def nicks(perf: DataFrame, sire: str, damsire: str, min_starts: int = 5,
          finish: str = "finish_position", odds: str | None = None) -> DataFrame:
    """Sire × dam's sire, kept from ``min_starts`` results on; with ``odds`` also their mean."""
    aggs = {"nicks_avg_finish": F.avg(finish), "nicks_count": F.count(finish), "nicks_std_finish": F.stddev_samp(finish)}
    if odds:
        aggs["nicks_avg_odds"] = F.avg(odds)
    return grouped(perf, [sire, damsire], aggs).filter(F.col("nicks_count") >= min_starts)


def sire_course(perf: DataFrame, keys: Sequence[str], finish: str = "finish_position", odds: str | None = None) -> DataFrame:
    """Mean finish of a sire's offspring per course; with ``odds`` also their mean."""
    aggs = {"sire_course_avg_finish": F.avg(finish)}
    if odds:
        aggs["sire_course_avg_odds"] = F.avg(odds)
    return grouped(perf, keys, aggs)


def mean_by(perf: DataFrame, keys: Sequence[str], out: str, target: str = "finish_position") -> DataFrame:
    """Mean of the target per key combination (bracket bias, duplicates)."""
    return grouped(perf, keys, {out: F.avg(target)})


def sigma_training(perf: DataFrame, predictions: DataFrame, entity: str, order: Sequence[str],
                   finish: str = "finish_position", age: str = "age") -> DataFrame:
    """Per entity: mean squared error against its prediction, age at the first row,
    mean and spread of finish, rows. Missing spread counts as 0."""
    mu = predictions.groupBy(entity).agg(F.avg("mu").alias("_mu"))
    rows = skew.lookup(perf, mu, [entity]).filter(F.col("_mu").isNotNull() & F.col(finish).isNotNull())
    error = F.col(finish) - F.col("_mu")
    return rows.groupBy(entity).agg(
        F.avg(error * error).alias("sigma_target"), F.min_by(age, F.struct(*order)).alias("age"),
        F.avg(finish).alias("mean_finish_pos"), F.coalesce(F.stddev_samp(finish), F.lit(0.0)).alias("std_finish_pos"),
        F.count(F.lit(1)).alias("total_races"))


def group_profile(df: DataFrame, group: str, order: Sequence[str], first: Sequence[str],
                  odds: str = "win_odds", number: str = "horse_number") -> DataFrame:
    """Per group: the first row's ``first`` columns, largest number, mean and spread of odds."""
    return df.groupBy(group).agg(
        *[F.min_by(c, F.struct(*order)).alias(c) for c in first],
        F.max(number).alias("head_count"), F.avg(odds).alias("avg_win_odds"),
        F.coalesce(F.stddev_samp(odds), F.lit(0.0)).alias("std_win_odds"))


def nu_target(df: DataFrame, group: str, finish: str = "finish_position") -> DataFrame:
    return df.groupBy(group).agg(F.coalesce(F.stddev_samp(finish), F.lit(0.0)).alias("nu_target"))


def numeric_means(df: DataFrame, group: str) -> DataFrame:
    """Mean of every numeric column per group."""
    from pyspark.sql import types as T
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != group]
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])


def totals_by(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(out))
