"""Column profiles from small mergeable sketches, one set a period.

A sketch is rows, so that merging is a plain aggregate with a map-side combine:

* ``distinct``: values are dealt to ``REGISTERS`` registers by hash, each keeps its smallest
  remaining hash. Merged by the minimum; gives distinct counts and overlaps.
* ``spread``: finite numbers fall into buckets that grow by a constant factor. Merged by
  sums, minima and maxima; gives mean, deviation and quantiles.

A period holds at most REGISTERS rows and some two thousand buckets per column, whatever
its data. Adding a period reads and writes that period alone.

Nulls count as ``nulls`` and in nothing else. NaN and infinities count among the distinct
values, but not in the spread. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

REGISTERS = 4096  # three hexadecimal digits of the hash; standard error of a distinct count about 1.6 %
_REST = 2.0 ** 48  # the next twelve digits
ERROR = 0.01  # of a quantile, relative
_ZERO = 1 << 20  # beyond the bucket numbers that doubles can reach at ERROR


def growth(error: float = ERROR) -> float:
    """Factor between bucket bounds for which the middle of a bucket is off by ``error`` at most."""
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """Bucket number, in the order of the values; 0 holds zero."""
    size = F.ceil(F.ln(F.abs(value)) / F.ln(F.lit(growth(error)))) + _ZERO
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size)


def middle(slot: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    g = F.lit(growth(error))
    size = 2 * F.pow(g, F.abs(slot) - _ZERO) / (g + 1)
    return F.when(slot == 0, F.lit(0.0)).otherwise(F.signum(slot) * size)


def sketch(df: DataFrame, period: str, columns: Sequence[str], error: float = ERROR) -> DataFrame:
    """Sketch rows (period, column, part, slot, rows, least, total, squares, low, high) of ``columns``."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    long = lambda names, value: df.select(
        F.col(period).alias("period"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in names])).alias("_c")).select("period", "_c.*")
    digest = F.md5(F.col("value").cast("binary"))
    slot, rest = (F.conv(F.substring(digest, at, n), 16, 10).cast("long") for at, n in ((1, 3), (4, 12)))
    nothing = F.lit(None).cast("double")
    out = (long(columns, lambda c: F.col(c).cast("string")).select("period", "column", slot.alias("slot"), rest.alias("rest"))
           .groupBy("period", "column", "slot").agg(F.count(F.lit(1)).alias("rows"), F.min("rest").alias("least"))
           .select("period", "column", F.lit("distinct").alias("part"), "slot", "rows", "least",
                   *[nothing.alias(n) for n in ("total", "squares", "low", "high")]))
    if not numeric:
        return out
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    spread = (long(numeric, lambda c: F.col(c).cast("double")).filter(finite)
              .groupBy("period", "column", bucket(v, error).alias("slot"))
              .agg(F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
                   F.min(v).alias("low"), F.max(v).alias("high")))
    return out.unionByName(spread.withColumns({"part": F.lit("spread"), "least": F.lit(None).cast("long")}))


def store(sketches: DataFrame, path: str) -> None:
    """Write whole periods, replacing those periods and leaving the others as they are."""
    (sketches.withColumn("of", F.col("period")).repartition("of").sortWithinPartitions("column", "part", "slot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").parquet(path))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All periods; a filter on ``of`` (the period) reads those folders alone."""
    return spark.read.parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch per column (and ``by``) from those of many periods."""
    return sketches.groupBy(*by, "column", "part", "slot").agg(
        F.sum("rows").alias("rows"), F.min("least").alias("least"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def _distinct() -> Column:
    """Most likely number of values: the smallest hash of a register is exponential, cut at one."""
    held = F.count("least")
    mass = F.sum((F.col("least") + 1) / _REST) + (REGISTERS - held)
    return REGISTERS * held / mass


def profile(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = (),
            error: float = ERROR) -> DataFrame:
    """Rows, nulls, distinct values, mean, deviation, bounds and quantiles per column (and ``by``).

    ``p{100 * prob}`` is within ``error`` of the value at rank ceil(prob * count), and within low and high.
    """
    one = merged(sketches, by)
    keys = [*by, "column"]
    values = one.filter("part = 'distinct'").groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("slot").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
        _distinct().alias("distinct"))
    w = Window.partitionBy(*keys)
    spread = one.filter("part = 'spread'").withColumns(
        {"_upto": F.sum("rows").over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("rows").over(w)})
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_n")), F.struct(F.col("slot"))))["slot"]
    n, total = F.sum("rows"), F.sum("total")
    numbers = spread.groupBy(*keys).agg(
        (total / n).alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("squares") - total * total / n, n - 1))).alias("deviation"),
        F.min("low").alias("low"), F.max("high").alias("high"), *[at(p).alias(f"_q{i}") for i, p in enumerate(probs)])
    numbers = numbers.select(*keys, "mean", "deviation", "low", "high", *[
        F.greatest("low", F.least("high", middle(F.col(f"_q{i}"), error))).alias(f"p{100 * p:g}") for i, p in enumerate(probs)])
    return values.join(numbers, keys, "left")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per column, shared distinct values over all distinct values of two sketches (0 when there are none)."""
    side = lambda df, name: merged(df.filter("part = 'distinct' AND slot IS NOT NULL")).select(
        "column", "slot", F.col("least").alias(name))
    both = side(left, "_a").join(side(right, "_b"), ["column", "slot"], "full")
    return both.groupBy("column").agg(F.avg(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).cast("double")).alias("overlap"))
