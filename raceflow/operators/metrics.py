"""Evaluation of predictions against results, and return series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.functions import bands
from raceflow.operators.ingroup import top_rows
from raceflow.session import cut_lineage


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str,
             carry: Mapping[str, Column] | None = None, hot=None) -> DataFrame:
    """Rank correlation of two columns per group (ties share the mean rank); NULL for a
    single row or a constant column. ``carry`` adds further aggregates."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranked(part, own):
        part = skew.rank_within(part, keys, a, "_ra", method="average", hot=own)
        return skew.rank_within(part, keys, b, "_rb", method="average", hot=own)

    rows = skew.by_part(rows, keys, hot, ranked)
    x, y, n = F.col("_ra"), F.col("_rb"), F.col("n")
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"),
        F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"), *[c.alias(k) for k, c in (carry or {}).items()])
    spread = (n * F.col("_xx") - F.col("_x") * F.col("_x")) * (n * F.col("_yy") - F.col("_y") * F.col("_y"))
    corr = F.when(spread > 0, (n * F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(spread))
    return sums.withColumn("correlation", corr).drop("_x", "_y", "_xy", "_xx", "_yy")


def correlation_summary(correlations: DataFrame) -> DataFrame:
    """Mean, median and population spread over the groups that have a value."""
    correlations = cut_lineage(correlations.select("correlation"))
    median, = skew.exact_quantiles(correlations, "correlation", [0.5])
    return correlations.agg(F.avg("correlation").alias("spearman_mean"),
                            F.lit(median).alias("spearman_median"),
                            F.stddev_pop("correlation").alias("spearman_std"))


def rmse(actual: str, predicted: str) -> Column:
    gap = F.col(predicted) - F.col(actual)
    return F.sqrt(F.avg(gap * gap))


def brier(probability: str, outcome: str) -> Column:
    gap = F.col(probability) - F.col(outcome)
    return F.avg(gap * gap)


def calibration_error(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    """Σ n/N · |mean p − mean y| over equal-width bins of [0, 1], the last one closed."""
    slot = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    per_bin = df.groupBy(slot.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.abs(F.avg(probability) - F.avg(outcome)).alias("_gap"))
    return per_bin.agg((F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"))


def quantile_slot(df: DataFrame, column: str, groups: int) -> Column:
    """Index of the quantile group (edge, next edge]; the lowest value joins the first.
    Equal edges are merged."""
    edges = skew.exact_quantiles(df, column, [i / groups for i in range(1, groups)])
    slot = F.lit(0)
    for e in sorted({e for e in edges if e is not None}):
        slot = slot + (F.col(column) > F.lit(e)).cast("int")
    return slot


def calibration_table(df: DataFrame, probability: str, outcome: str, groups: int = 10) -> DataFrame:
    return df.groupBy(quantile_slot(df, probability, groups).alias("bin")).agg(
        F.avg(probability).alias("mean_probability"), F.avg(outcome).alias("hit_rate"),
        F.count(F.lit(1)).alias("rows")).withColumn("error", F.col("mean_probability") - F.col("hit_rate"))


def top_k_overlap(df: DataFrame, group: str, entity: Sequence[str], score: str, actual: str,
                  ks: Sequence[int], hot=None) -> DataFrame:
    """Per k: share of groups (with at least k rows) whose predicted and actual first k
    have a member in common."""
    def placed(rows, own):
        rows = skew.row_numbers(rows, [group], [score, *entity], "_p", own)
        return skew.row_numbers(rows, [group], [actual, *entity], "_a", own)

    # one pass: the smallest k at which the group has an overlap is min(max(p, a))
    ranked = skew.by_part(df.select(group, *entity, score, actual), [group], hot, placed)
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(F.greatest("_p", "_a")).alias("_first"))
    k = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return (sizes.select("_n", "_first", k).filter(F.col("_n") >= F.col("k")).groupBy("k")
            .agg(F.count(F.lit(1)).alias("races"),
                 F.avg(F.coalesce((F.col("_first") <= F.col("k")).cast("int"), F.lit(0))).alias("accuracy")))


def fractional_top_roi(df: DataFrame, group: str, order: Sequence, share: float = 0.2,
                       finish: str = "finish_position", odds: str = "win_odds", hot=None) -> DataFrame:
    """Return in percent of one unit on the best max(1, ⌊n·share⌋) rows per group."""
    def numbered(rows, own):
        return skew.row_numbers(skew.over_group(rows, [group], {"_n": F.count(F.lit(1))}, own), [group], order, "_pos", own)

    placed = skew.by_part(df, [group], hot, numbered)
    bets = placed.filter(F.col("_pos") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    paid = F.coalesce(F.sum(F.when(F.col(finish) == 1, F.col(odds))), F.lit(0.0))
    return bets.agg(F.count(F.lit(1)).alias("bets"), paid.alias("returned")).withColumn(
        "roi", F.coalesce(F.try_divide((F.col("returned") - F.col("bets")) * 100, F.col("bets")), F.lit(0.0)))


def daily_evaluation(df: DataFrame, group: str, day: str, order: Sequence[str], score: str, ascending: bool = True,
                     actual_time: str | None = "finish_time_seconds", finish: str = "finish_position",
                     odds: str = "win_odds", stake: int = 100, hot=None) -> DataFrame:
    """Per day: RMSE, mean rank correlation, hit rate (pick in the first three) and
    recovery of a fixed stake on each race's best score; one-row races do not count."""
    picks = top_rows(df, [group], [(score, ascending), *order], 1).select(
        group, F.col(finish).alias("_f"), F.col(odds).alias("_o"))
    races = spearman(df, [group], score, finish, {day: F.min(day)}, hot).filter("n > 1").join(picks, group)
    paid = F.when((F.col("_f") == 1) & (F.col("_o") > 0), F.col("_o") * stake).otherwise(0.0)
    daily = races.groupBy(day).agg(
        F.coalesce(F.avg("correlation"), F.lit(0.0)).alias("spearman_corr"),
        F.avg((F.col("_f") <= 3).cast("int")).alias("hit_rate"), F.count(F.lit(1)).alias("race_count"),
        (F.count(F.lit(1)) * stake).alias("total_bet"), F.sum(paid).alias("total_return"))
    daily = daily.withColumn("recovery_rate", F.try_divide("total_return", "total_bet"))
    if actual_time is None:
        return daily
    return daily.join(df.groupBy(day).agg(rmse(actual_time, score).alias("rmse")), day, "left")


def threshold_sweep(df: DataFrame, group: str, tie: Sequence[str], thresholds: Sequence[float],
                    probability: str = "win_probability", winner: str = "is_winner", odds: str = "win_odds") -> DataFrame:
    """Per threshold: best pick of each race that reaches it, wins, win rate and return.

    The best pick of a race does not depend on the threshold, so one row per race is
    kept and then counted under every threshold it reaches.
    """
    best = top_rows(df, [group], [(probability, False), *tie], 1)
    reached = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(probability))
    rows = best.select(F.explode(reached).alias("threshold"), winner, odds)
    return rows.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("races"), F.sum(winner).alias("wins"), F.avg(winner).alias("win_rate"),
        F.coalesce(F.avg(F.when(F.col(odds).isNotNull(), F.col(winner) * F.col(odds))), F.lit(0.0)).alias("roi"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("roi"), "threshold").limit(1)


def segment_report(df: DataFrame, group: str, segments: Mapping[str, Column], score: str, finish: str,
                   min_rows: int = 10) -> DataFrame:
    """Rank correlation per value of each segmenting column, values with enough rows only.

    The rows are stored once; they are then dealt by segment, value and group into tasks of bounded size.
    """
    labels = {f"_s{i}": c.cast("string") for i, c in enumerate(segments.values())}
    df = cut_lineage(df.select(group, score, finish, *[c.alias(n) for n, c in labels.items()]))
    labelled = F.explode(F.array(*[
        F.struct(F.lit(n).alias("segment"), F.col(c).alias("value")) for n, c in zip(segments, labels)])).alias("s")
    rows = df.select(group, score, finish, labelled).select(group, score, finish, "s.*").filter("value IS NOT NULL")
    keys = ["segment", "value", group]
    hot = None if skew.hot_keys(df, [group]) else []  # without a hot group no part of one is hot
    races = spearman(skew.dealt(rows, keys, df.count() * len(segments)), keys, score, finish, hot=hot)
    return races.groupBy("segment", "value").agg(
        F.sum("n").alias("rows"), F.avg("correlation").alias("spearman_mean"),
        F.stddev_pop("correlation").alias("spearman_std")).filter(
        (F.col("rows") >= min_rows) & F.col("spearman_mean").isNotNull())


def worst_groups(correlations: DataFrame, group: str, above: float = -0.3, n: int = 20) -> DataFrame:
    """Groups whose correlation is too weak, the worst first."""
    return correlations.filter(F.col("correlation") > above).orderBy(F.desc("correlation"), group).limit(n)


def error_distribution(correlations: DataFrame, columns: Sequence[str], above: float = -0.3) -> DataFrame:
    """Weak groups counted by value of each column."""
    labelled = F.explode(F.array(*[
        F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")
    return correlations.filter(F.col("correlation") > above).select(labelled).groupBy(
        "s.segment", "s.value").agg(F.count(F.lit(1)).alias("races"))


def by_popularity(df: DataFrame, popularity: str, probability: str, winner: str) -> DataFrame:
    label = bands.right_closed(F.col(popularity), [(3, "favourites"), (6, "middle"), (20, "outsiders")])
    return _agreement(df.withColumn("popularity_group", label).filter("popularity_group IS NOT NULL"),
                      "popularity_group", probability, winner)


def by_confidence(df: DataFrame, sigma: str, probability: str, winner: str) -> DataFrame:
    """Thirds of predicted uncertainty, the smallest first."""
    known = df.filter(F.col(sigma).isNotNull())
    slot = quantile_slot(known, sigma, 3)
    label = F.when(slot == 0, "high").when(slot == 1, "medium").otherwise("low")
    return _agreement(known.withColumn("confidence", label), "confidence", probability, winner,
                      F.avg(sigma).alias("mean_sigma"))


def _agreement(df, key, probability, winner, *more):
    return df.groupBy(key).agg(F.avg(probability).alias("mean_probability"), F.avg(winner).alias("hit_rate"),
                               F.count(F.lit(1)).alias("rows"), *more)


def fixed_threshold_backtest(probabilities: DataFrame, winners: DataFrame, group: str, runner: str,
                             probability: str, minimum: float = 0.2, stake: int = 100) -> DataFrame:
    """Fixed stake on each race's most probable runner when it reaches the minimum."""
    best = top_rows(probabilities, [group], [(probability, False), runner], 1).filter(F.col(probability) >= minimum)
    won = winners.select(group, F.col(runner).alias("_w"), F.col("win_odds").alias("_o"))
    hit = F.coalesce(F.col(runner) == F.col("_w"), F.lit(False))
    out = best.join(won, group, "left").agg(
        F.count(F.lit(1)).alias("bets"), F.count_if(hit).alias("hits"),
        F.coalesce(F.sum(F.when(hit, F.col("_o") * stake)), F.lit(0.0)).alias("returned"))
    return out.select("bets", "hits", (F.col("bets") * stake).alias("staked"), "returned",
                      (F.try_divide("hits", "bets") * 100).alias("hit_rate"),
                      (F.try_divide("returned", F.col("bets") * stake) * 100).alias("roi"))


def equity_curve(daily: DataFrame, day: str, ret: str, capital: float = 1.0, series: str | None = None) -> DataFrame:
    """Capital, running peak and drawdown of daily returns (one row per series and day)."""
    upto = Window.orderBy(day) if series is None else Window.partitionBy(series).orderBy(day)
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    grown = daily.withColumn("capital", F.exp(F.sum(F.log1p(ret)).over(upto)) * capital)
    peak = grown.withColumn("peak", F.max("capital").over(upto))
    return peak.withColumn("drawdown", (F.col("capital") - F.col("peak")) / F.col("peak"))


def return_summary(curve: DataFrame, day: str, ret: str, capital: float = 1.0) -> DataFrame:
    return curve.agg(
        (F.max_by("capital", day) / capital - 1).alias("total_return"), F.min("drawdown").alias("max_drawdown"),
        (F.try_divide(F.avg(ret), F.stddev_samp(ret)) * F.sqrt(F.lit(252.0))).alias("sharpe"))


def monthly_pivot(daily: DataFrame, day: str, ret: str) -> DataFrame:
    """Sum of returns, one row per year and one column per month."""
    return (daily.select(F.year(day).alias("year"), F.month(day).alias("_m"), ret)
            .groupBy("year").pivot("_m", list(range(1, 13))).agg(F.sum(ret))
            .withColumnsRenamed({str(m): f"month_{m}" for m in range(1, 13)}))


def mean_change(daily: DataFrame, day: str, metrics: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Mean of each daily metric and of its day-to-day change inside [start, end]."""
    w = Window.orderBy(day)
    inside = daily.filter(F.col(day).between(start, end))
    moved = inside.withColumns({f"_d_{m}": F.col(m) - F.lag(m).over(w) for m in metrics})
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(m), F.avg(f"_d_{m}").alias(f"{m}_change")]
    return moved.agg(*aggs)
