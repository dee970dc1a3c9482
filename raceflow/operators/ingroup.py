"""Measures relative to the other rows of the same group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow import skew


def z_score(df: DataFrame, group: str, columns: Sequence[str], hot=None) -> DataFrame:
    """``c_zscore`` = (x − mean) / (sample std + 1e-6); NULL in a one-row group."""
    aggs = {}
    for c in columns:
        aggs[f"_m_{c}"], aggs[f"_s_{c}"] = F.avg(c), F.stddev_samp(c)
    out = skew.over_group(df, [group], aggs, hot)
    return out.withColumns({
        f"{c}_zscore": (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + F.lit(1e-6)) for c in columns
    }).drop(*aggs)


def deviation_score(df: DataFrame, group: str, column: str, out: str, damped: bool = False,
                    hot=None) -> DataFrame:
    """50 + 10·(x − mean)/std, only where std > 0; ``damped`` divides by std + 0.1."""
    wide = skew.over_group(df, [group], {"_m": F.avg(column), "_s": F.stddev_samp(column)}, hot)
    gap = F.col(column) - F.col("_m")
    score = (50 + 10 * gap / (F.col("_s") + 0.1) if damped
             else F.when(F.col("_s") > 0, 50 + 10 * F.try_divide(gap, F.col("_s"))))
    return wide.withColumn(out, score).drop("_m", "_s")


def gap_to_best(df: DataFrame, group: str, column: str, out: str, hot=None) -> DataFrame:
    wide = skew.over_group(df, [group], {"_best": F.min(column)}, hot)
    return wide.withColumn(out, F.col(column) - F.col("_best")).drop("_best")


def gap_and_ratio_to_mean(df: DataFrame, group: str, column: str, gap: str, ratio: str,
                          hot=None) -> DataFrame:
    wide = skew.over_group(df, [group], {"_m": F.avg(column)}, hot)
    return wide.withColumns({gap: F.col(column) - F.col("_m"),
                             ratio: F.try_divide(F.col(column), F.col("_m"))}).drop("_m")


def group_size(df: DataFrame, group: str, out: str = "head_count", hot=None) -> DataFrame:
    return skew.over_group(df, [group], {out: F.count(F.lit(1))}, hot)


def at_least(df: DataFrame, group: str, n: int, hot=None) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    return group_size(df, group, "_n", hot).filter(F.col("_n") >= n).drop("_n")


def outlier_flag(df: DataFrame, keys: Sequence[str], column: str, out: str = "time_outlier_flag",
                 sigmas: float = 3.0) -> DataFrame:
    """Outside mean ± ``sigmas``·std of its group. Few, very large groups: the bounds
    are aggregated and joined, the rows are not regrouped."""
    bounds = df.groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    wide = skew.lookup(df, bounds, keys, null_matches=True)
    outside = F.abs(F.col(column) - F.col("_m")) > sigmas * F.col("_s")
    return wide.withColumn(out, F.coalesce(outside, F.lit(False))).drop("_m", "_s")


def relevance(df: DataFrame, group: str, order, out: str = "relevance", ceiling: int = 30,
              hot=None) -> DataFrame:
    """Rows behind this one in its group, clipped to 0…ceiling (the best gets most)."""
    def numbered(rows, own):
        return skew.row_numbers(group_size(rows, group, "_n", own), [group], order, "_pos", own)

    label = F.greatest(F.lit(0), F.least(F.lit(ceiling), F.col("_n") - F.col("_pos")))
    return skew.by_part(df, [group], hot, numbered).withColumn(out, label).drop("_n", "_pos")


def share_by_value(df: DataFrame, group: str, column: Column, names: dict[str, str], hot=None) -> DataFrame:
    """Per group, the share of rows whose ``column`` equals each value in ``names``."""
    aggs = {name: F.avg(F.when(column == value, 1.0).otherwise(0.0)) for value, name in names.items()}
    return skew.over_group(df, [group], aggs, hot)


def top_rows(df: DataFrame, keys: Sequence[str], order, n: int) -> DataFrame:
    """First ``n`` rows per group; limited before the shuffle."""
    w = skew.ordered_window(keys, order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def best_row(df: DataFrame, group: str, score: str, tie: Sequence[str], ascending: bool = True) -> DataFrame:
    """The row with the smallest (or largest) score per group."""
    return top_rows(df, [group], [(score, ascending), *tie], 1)
