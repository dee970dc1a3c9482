"""Data-quality profiles and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceflow import skew

# Limits of the checks.
THRESHOLDS = {"max_404_rate": 0.01, "max_parse_error_rate": 0.02, "max_missing_rate": 0.10,
              "max_outlier_rate": 0.05, "min_rows": 1000}
FORBIDDEN_FEATURES = ["win_odds", "place_odds", "popularity", "finish_position", "finish_time_seconds", "prize_money"]
LIMITS = {"distance_m": (100, 4000), "finish_time_seconds": (50, 500)}
RESULT_SCHEMA = "check string, status string, message string, value double"


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, flag_above: float = 0.10) -> DataFrame:
    """Type, NULL count and rate and distinct values per column.

    Distinct values come from (column, value) pairs combined before the shuffle, so
    neither a frequent value nor a wide column gathers in one task.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell")
    pairs = df.select(cells).groupBy("cell.column", "cell.value").agg(F.count(F.lit(1)).alias("_n"))
    rows = F.sum("_n")
    out = pairs.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        rows.alias("_rows"), F.count("value").alias("distinct_values"))
    kind = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    rate = F.col("nulls") / F.col("_rows")
    return out.select("column", kind[F.col("column")].alias("type"), "nulls", rate.alias("null_rate"),
                      "distinct_values", (rate > flag_above).alias("flagged"))


def family_null_rate(profile: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Mean NULL rate of the columns whose name contains one of a family's texts."""
    label = F.lit("other")
    for name, texts in reversed(families.items()):
        label = F.when(reduce(lambda a, b: a | b, [F.col("column").contains(t) for t in texts]), name).otherwise(label)
    return profile.filter("nulls > 0").groupBy(label.alias("family")).agg(
        F.count(F.lit(1)).alias("columns"), F.avg("null_rate").alias("mean_null_rate"))


def describe_with_outliers(df: DataFrame, columns: Sequence[str], spread: float = 3.0) -> DataFrame:
    """count, mean, std, min, quartiles, max, and rows beyond ``spread``·IQR per column."""
    quartiles = skew.column_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    made = []
    for c in columns:
        q1, q2, q3 = (F.lit(q).cast("double") for q in quartiles[c])
        x, reach = F.col(c), spread * (q3 - q1)
        made.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).cast("double").alias("min"), q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
            F.max(x).cast("double").alias("max"), F.count_if((x < q1 - reach) | (x > q3 + reach)).alias("outliers")))
    return df.agg(F.array(*made).alias("_c")).select(F.inline("_c"))


def group_sizes(df: DataFrame, group: str, low: int = 5, high: int = 20) -> DataFrame:
    """How many groups have each size; sizes outside low…high are abnormal."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups")).withColumn(
        "abnormal", (F.col("size") < low) | (F.col("size") > high))


def size_summary(distribution: DataFrame) -> DataFrame:
    """describe() of the group sizes, from their distribution."""
    size, n = F.col("size").cast("double"), F.col("groups")
    total = F.sum(n)
    mean = F.sum(size * n) / total
    variance = F.try_divide(F.sum(size * size * n) - F.sum(size * n) * F.sum(size * n) / total, total - 1)
    q = [F.percentile("size", p, n).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return distribution.agg(total.alias("groups"), mean.alias("mean"), F.sqrt(variance).alias("std"),
                            F.min("size").alias("min"), *q, F.max("size").alias("max"))


def varies(column: str) -> Column:
    """True when a group holds more than one distinct non-NULL value (no distinct set kept)."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def inconsistent_groups(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which a column that should be constant is not."""
    flags = [f"{c}_varies" for c in columns]
    return df.groupBy(*group).agg(*[varies(c).alias(f) for c, f in zip(columns, flags)]).filter(
        reduce(lambda a, b: a | b, [F.col(f) for f in flags]))


def duplicate_profile(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, rows in full duplicates, rows in key duplicates, partial duplicates, unique rows."""
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    keyed = full.groupBy(*key).agg(F.sum("_n").alias("_k"), F.sum(F.when(F.col("_n") > 1, F.col("_n"))).alias("_f"))
    out = keyed.agg(F.sum("_k").alias("rows"), F.coalesce(F.sum("_f"), F.lit(0)).alias("full_duplicates"),
                    F.coalesce(F.sum(F.when(F.col("_k") > 1, F.col("_k"))), F.lit(0)).alias("key_duplicates"))
    return out.withColumns({"partial_duplicates": F.col("key_duplicates") - F.col("full_duplicates"),
                            "unique_rows": F.col("rows") - F.col("key_duplicates")})


def multiplicity(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys occur twice, three times, …"""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
            .groupBy("times").agg(F.count(F.lit(1)).alias("keys")))


def top_offenders(df: DataFrame, key: Sequence[str], n: int = 5) -> DataFrame:
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
            .orderBy(F.desc("times"), *key).limit(n))


def varying_columns(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per non-key column, the duplicated keys in which it takes several values."""
    columns = [c for c in df.columns if c not in key]
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[varies(c).alias(c) for c in columns]).filter("_n > 1")
    counted = dup.agg(*[F.count_if(c).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "keys")


def duplication_ratio(df: DataFrame, group: str, entity: str) -> DataFrame:
    """Rows per distinct entity in each group."""
    pairs = df.groupBy(group, entity).agg(F.count(F.lit(1)).alias("_n"))
    out = pairs.groupBy(group).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("entities"))
    return out.withColumn("ratio", F.col("rows") / F.col("entities"))


def coverage_calendar(df: DataFrame, day: str, group: str) -> DataFrame:
    """Rows, distinct groups and distinct days per year and month."""
    once = df.groupBy(F.year(day).alias("year"), F.month(day).alias("month"), group, day).agg(
        F.count(F.lit(1)).alias("_n"))
    return once.groupBy("year", "month").agg(F.sum("_n").alias("rows"), F.countDistinct(group).alias("groups"),
                                             F.countDistinct(day).alias("days"))


def null_rate_by(df: DataFrame, stratum: str, columns: Sequence[str]) -> DataFrame:
    """Per stratum: rows, mean NULLs per row, and the NULL rate of each column."""
    nulls = [F.col(c).isNull().cast("int") for c in columns]
    return df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(reduce(lambda a, b: a + b, nulls)).alias("mean_nulls"),
        *[F.avg(n).alias(f"{c}_null_rate") for c, n in zip(columns, nulls)])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def examples(df: DataFrame, source: str, column: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct values per source, as one array."""
    distinct = df.select(source, column).filter(F.col(column).isNotNull()).distinct()
    ranked = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(column)))
    return ranked.filter(F.col("_r") <= n).groupBy(source).agg(
        F.sort_array(F.collect_list(column)).alias("examples"))


# ---- checks -----------------------------------------------------------------

def result(df: DataFrame, check: str, value: Column, passed: Column, good: str, bad: str,
           failure: str = "warning") -> DataFrame:
    """One check = one aggregate = one result row; the message ends with the value."""
    row = df.agg(value.cast("double").alias("value"))
    ok = F.coalesce(passed, F.lit(False))
    return row.select(F.lit(check).alias("check"), F.when(ok, "pass").otherwise(failure).alias("status"),
                      F.when(ok, good).otherwise(bad).alias("message"), "value")


def schema_check(name: str, df: DataFrame, required: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Rows (table, column, issue) for absent required and non-numeric number columns."""
    types = {f.name: f.dataType for f in df.schema}
    issues = [(name, c, "missing") for c in required if c not in types]
    issues += [(name, c, f"not numeric: {types[c].simpleString()}") for c in numeric
               if c in types and not isinstance(types[c], T.NumericType)]
    return df.sparkSession.createDataFrame(issues, "table string, column string, issue string")


def consistency_checks(df: DataFrame, finish: str = "finish_position", size: str = "head_count") -> DataFrame:
    """Rows breaking each logical rule, from one pass."""
    rules = {}
    if {finish, size} <= set(df.columns):
        rules["finish_beyond_field"] = F.col(finish) > F.col(size)
    for c, (low, high) in LIMITS.items():
        if c in df.columns:
            rules[f"{c}_out_of_range"] = (F.col(c) < low) | (F.col(c) > high)
    counted = df.agg(*[F.count_if(r).alias(n) for n, r in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def feature_checks(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN_FEATURES,
                   max_null_rate: float = THRESHOLDS["max_missing_rate"]) -> DataFrame:
    """Per column: forbidden name, NULL rate over the limit, NaN and infinite values."""
    parts = []
    for f in df.schema:
        x = F.col(f.name)
        real = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        parts.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.name in forbidden).alias("forbidden"),
            F.avg(x.isNull().cast("int")).alias("null_rate"),
            (F.count_if(F.isnan(x)) if real else F.lit(0).cast("long")).alias("nans"),
            (F.count_if(F.abs(x) == float("inf")) if real else F.lit(0).cast("long")).alias("infinite")))
    rows = df.agg(F.array(*parts).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")
    return rows.withColumn("too_many_nulls", F.col("null_rate") > max_null_rate)


def validation_results(tables: Mapping[str, DataFrame], watch: Mapping[str, Sequence[str]]) -> DataFrame:
    """Result rows per table: row count and worst NULL rate of the watched columns."""
    rows = []
    for name, df in tables.items():
        low = THRESHOLDS["min_rows"]
        rows.append(result(df, f"{name}_rows", F.count(F.lit(1)), F.col("value") >= low, "enough rows", "too few rows"))
        rates = [F.avg(F.col(c).isNull().cast("int")) for c in watch.get(name, [])]
        if rates:
            worst = F.array_max(F.array(*rates))
            rows.append(result(df, f"{name}_missing", worst, F.col("value") <= THRESHOLDS["max_missing_rate"],
                               "few missing values", "many missing values"))
    return reduce(DataFrame.unionByName, rows)


def file_results(sizes: DataFrame) -> DataFrame:
    """A result row per folder of ``files.file_size_summary``: small files are taken for 404 pages."""
    ok = F.col("small_rate") <= THRESHOLDS["max_404_rate"]
    return sizes.select(F.concat(F.lit("scraping_"), "folder").alias("check"), F.when(ok, "pass").otherwise("warning").alias("status"),
                        F.when(ok, "few small files").otherwise("many small files").alias("message"), F.col("small_rate").alias("value"))


def parse_results(good: DataFrame, failures: DataFrame, name: str) -> DataFrame:
    """One row: failed rows as a share of all rows of a quarantine split."""
    rows = good.select(F.lit(0).alias("bad")).unionByName(failures.select(F.lit(1).alias("bad")))
    return result(rows, f"{name}_parse_errors", F.avg("bad"), F.col("value") <= THRESHOLDS["max_parse_error_rate"],
                  "few parse errors", "many parse errors")


def outlier_results(described: DataFrame, name: str) -> DataFrame:
    """A row per described column: the share of rows beyond the IQR fences."""
    rate = F.coalesce(F.try_divide(F.col("outliers").cast("double"), F.col("count")), F.lit(0.0))
    ok = rate <= THRESHOLDS["max_outlier_rate"]
    return described.select(F.concat(F.lit(f"{name}_outliers_"), "column").alias("check"),
                            F.when(ok, "pass").otherwise("warning").alias("status"),
                            F.when(ok, "few outliers").otherwise("many outliers").alias("message"), rate.alias("value"))


def status_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def metric_alerts(history: DataFrame, metric: str, run: str, value: str, sigmas: float = 3.0,
                  min_runs: int = 5) -> DataFrame:
    """Each run against mean ± 3σ of the metric's earlier runs: ok, warning (2σ) or
    critical. One row per metric and run, so the window is short."""
    earlier = Window.partitionBy(metric).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumns({"baseline": F.avg(value).over(earlier), "_s": F.stddev_samp(value).over(earlier),
                               "runs_before": F.count(value).over(earlier)})
    gap = F.abs(F.col(value) - F.col("baseline"))
    enough = F.col("runs_before") >= min_runs
    return out.withColumn("severity", F.when(~enough, "learning").when(gap > sigmas * F.col("_s"), "critical")
                          .when(gap > (sigmas - 1) * F.col("_s"), "warning").otherwise("ok")).drop("_s")


# Metric, comparison, limit, advice. The first matching row per metric counts.
ADVICE = [
    ("spearman_mean", ">", -0.3, "weak ranking: review features and model"),
    ("spearman_mean", ">", -0.5, "moderate ranking: features can be improved"),
    ("spearman_mean", "<=", -0.5, "good ranking"),
    ("brier_score", ">", 0.25, "high Brier score: calibrate probabilities"),
    ("ece", ">", 0.1, "probabilities are not calibrated"),
    ("roi", "<", 0.0, "negative return: review the betting rule"),
    ("roi", ">", 10.0, "good return"),
    ("worst_segment", ">", -0.3, "weak segment: add features or data for it"),
    ("worst_races", ">", 0.0, "races with especially weak predictions: look for what they share"),
]


def recommendations(metrics: DataFrame) -> DataFrame:
    """Advice per (metric, value) row, by the rule table above."""
    rules = metrics.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(ADVICE)], "rule int, metric string, op string, bound double, advice string")
    v, b = F.col("value"), F.col("bound")
    holds = F.when(F.col("op") == ">", v > b).when(F.col("op") == "<", v < b).otherwise(v <= b)
    matched = metrics.join(F.broadcast(rules), "metric").filter(holds)
    keys = [c for c in metrics.columns]
    return matched.groupBy(*keys).agg(F.min_by("advice", "rule").alias("advice"))


def report_lines(results: DataFrame, title: str) -> DataFrame:
    """Markdown lines, numbered, from a result table (a handful of rows)."""
    body = results.select(F.concat(F.lit("- **"), "status", F.lit("** "), "check", F.lit(": "), "message",
                                   F.lit(" ("), F.format_number("value", 4), F.lit(")")).alias("text"),
                          F.when(F.col("status") == "fail", 2).when(F.col("status") == "warning", 3).otherwise(4).alias("_o"))
    head = results.agg(F.concat(F.lit(f"# {title}: "), F.count(F.lit(1)), F.lit(" checks")).alias("text"), F.lit(1).alias("_o"))
    return head.unionByName(body).withColumn("line", F.row_number().over(Window.orderBy("_o", "text"))).select("line", "text")
