"""Joins and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.operators.ingroup import top_rows


def lookup_left(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a table that is unique on ``on``. Whether it is broadcast is left
    to the planner's size estimate."""
    return df.join(dim, list(on), "left")


def replace_from(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which the other side's columns replace same-named ones."""
    fresh = [c for c in other.columns if c not in on]
    return df.drop(*fresh).join(other, list(on), "left")


def fill_from(df: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fill only the NULLs of ``columns`` from the other table (unique on ``on``)."""
    source = other.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(source, list(on), "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_new_{c}")) if c in df.columns else F.col(f"_new_{c}")
              for c in columns}
    return joined.withColumns(filled).drop(*[f"_new_{c}" for c in columns])


def work_list(inputs: DataFrame, done: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Inputs not processed yet, plus those whose earlier attempt failed."""
    todo = inputs.join(done.select(key), key, "left_anti")
    retry = inputs.join(done.select(key), key, "left_semi").join(errors.select(key), key, "left_semi")
    return todo.unionByName(retry)


def key_coverage(named: dict[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """Distinct keys by the set of tables they occur in: one row per combination."""
    marked = [df.select(*key).distinct().withColumn("_t", F.lit(name)) for name, df in named.items()]
    seen = reduce(DataFrame.unionByName, marked).groupBy(*key).agg(
        *[F.max(F.when(F.col("_t") == n, 1).otherwise(0)).alias(f"in_{n}") for n in named])
    flags = [f"in_{n}" for n in named]
    return seen.groupBy(*flags).agg(F.count(F.lit(1)).alias("keys"))


def overlap_sizes(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """|A ∩ B|, |A − B| and |B − A| on distinct keys."""
    a = left.select(*key).distinct().withColumn("_a", F.lit(1))
    b = right.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"))


def through_parent(df: DataFrame, child_to_parent: str, key: str, wanted: str, out: str) -> DataFrame:
    """Read ``wanted`` from the row of the same table that ``child_to_parent`` points at."""
    parents = df.select(F.col(key).alias(child_to_parent), F.col(wanted).alias(out)).filter(
        F.col(child_to_parent).isNotNull())
    return df.join(parents, child_to_parent, "left")


def match_rate(left: DataFrame, right: DataFrame, on: Sequence[str], watch: str) -> DataFrame:
    """Rows before and after a left join, and the share of rows whose ``watch`` column matched."""
    before = left.agg(F.count(F.lit(1)).alias("rows_before"))
    joined = left.join(right, list(on), "left").agg(
        F.count(F.lit(1)).alias("rows_after"), F.avg(F.col(watch).isNotNull().cast("int")).alias("matched"))
    out = joined.withColumn("rows_before", before.scalar())
    return out.withColumn("grew", F.col("rows_after") > F.col("rows_before"))


def suffix_collisions(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str) -> DataFrame:
    """Rename the right side's non-key columns that the left side already has."""
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return right.withColumnsRenamed({c: c + suffix for c in clash})


def wide_join(base: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Chain of left joins; each other table must be unique on its key, so that the
    row count cannot change."""
    out = base
    for df, on, suffix in others:
        out = out.join(suffix_collisions(out, df, on, suffix), list(on), "left")
    return out


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Existing ∪ new, the last row per key winning: new over existing, then by ``order``."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(
        new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    newest_first = [("_src", False), *[(c, False) for c in order]]
    return top_rows(both, keys, newest_first, 1).drop("_src")


def replace_slice(existing: DataFrame, new: DataFrame, in_slice) -> DataFrame:
    """Existing rows outside the slice, plus the new ones."""
    return existing.filter(~F.coalesce(in_slice, F.lit(False))).unionByName(new, allowMissingColumns=True)


def outer_concat(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def missing_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).subtract(b.select(*key))


def resolve_errors(errors: DataFrame, output: DataFrame, key: str) -> DataFrame:
    """Recorded failures whose key has not since appeared in the output."""
    return errors.join(output.select(key), key, "left_anti")


def stats_lookup(df: DataFrame, stats: DataFrame, keys: Sequence[str], null_matches: bool = False) -> DataFrame:
    """Attach per-key statistics on two or more keys; see ``skew.lookup``."""
    return skew.lookup(df, stats, keys, null_matches=null_matches)
