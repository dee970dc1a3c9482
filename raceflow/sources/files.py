"""Reading and writing tables, documents and logs."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceflow.session import cut_lineage

log = logging.getLogger(__name__)

# Outcomes and odds are stored as one row per outcome, whatever the size of the race.
OUTCOME_SCHEMA = "race_id string, model_id string, created_ts string, market string, key string, probability double"
ODDS_SCHEMA = "race_id string, snapshot_ts string, market string, key string, odds double, popularity int"


def read_by_date(spark: SparkSession, path: str, start: str, end: str, day: str = "race_date") -> DataFrame:
    """Parquet below ``path`` with ``day`` inside [start, end].

    A date or timestamp column is compared as stored, so the range reaches the
    Parquet footer statistics; a text column is read as a date first, unreadable
    days being dropped. Without the column everything is returned, with a warning.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option(
        "pathGlobFilter", "*.parquet").parquet(path)
    if day not in df.columns:
        log.warning("no column %s below %s: rows are not filtered by date", day, path)
        return df
    kind = df.schema[day].dataType
    if isinstance(kind, T.DateType):
        return df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return df.filter((F.col(day) >= F.lit(start).cast(kind))
                         & (F.col(day) < F.date_add(F.lit(end).cast("date"), 1).cast(kind)))
    parsed = F.to_date(F.col(day).try_cast("date")) if isinstance(kind, T.StringType) else F.col(day).cast("date")
    return df.filter(parsed.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read_partitions(spark: SparkSession, path: str, **values) -> DataFrame:
    """Hive-partitioned Parquet; other files are ignored and ``values`` prune directories."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    for column, value in values.items():
        df = df.filter(F.col(column).isin(value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return df


def read_latest_per_partition(spark: SparkSession, path: str) -> DataFrame:
    """Only the newest file of every partition directory, by file time and then path.

    The newest file of a folder comes from the rows' file metadata (footers only), and
    rows are kept by joining on their file, so no list of files passes through the driver.
    """
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    file = F.col("_metadata.file_path")
    newest = rows.groupBy(F.regexp_replace(file, "/[^/]+$", "").alias("folder")).agg(
        F.max(F.struct(F.col("_metadata.file_modification_time").alias("t"), file.alias("p"))).alias("f"))
    newest = newest.select(F.col("f.p").alias("_file"))
    return rows.select("*", file.alias("_file")).join(newest, "_file", "left_semi").drop("_file")


def partition_columns(df: DataFrame, day: str = "race_date", fallback_id: str | None = None) -> DataFrame:
    """``year, month, day`` from the date, else from the first 8 characters of an id."""
    date = F.col(day).try_cast("date") if day in df.columns else F.lit(None).cast("date")
    if fallback_id:
        date = F.coalesce(date, F.try_to_date(F.substring(F.col(fallback_id).cast("string"), 1, 8), "yyyyMMdd"))
    return df.withColumns({"year": F.year(date), "month": F.month(date), "day": F.dayofmonth(date)})


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Snappy Parquet replacing only the partitions present in ``df``.

    ``rebalance`` groups rows by partition before writing, which avoids many small
    files, and lets AQE split a partition that is too large for one task.
    """
    by = [c for c in by if c in df.columns]
    writer = df.hint("rebalance", *[F.col(c) for c in by]) if by else df
    writer = writer.write.mode("overwrite").option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_files(df: DataFrame, path: str, files: int | None = None) -> None:
    """``files`` files (one for a result known to be small), or well-sized ones."""
    (df.repartition(files) if files else df.hint("rebalance")).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Many small daily files into one table of well-sized files."""
    spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(source).hint(
        "rebalance").write.mode("overwrite").parquet(target)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; columns go by position, so a byte-order mark in it is harmless."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True)


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> None:
    if byte_order_mark:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_outcomes(spark: SparkSession, path: str, prefix: str = "", glob: str = "*.{json,json.gz}") -> DataFrame:
    """Stored outcome rows, optionally of races whose id starts with ``prefix``."""
    df = spark.read.option("pathGlobFilter", glob).schema(OUTCOME_SCHEMA).json(path)
    return df.filter(F.col("race_id").startswith(prefix)) if prefix else df


def latest_rows(df: DataFrame, key: Sequence[str], stamp: str) -> DataFrame:
    """All rows of the newest ``stamp`` of every key; a large key is split like any join.

    The newest stamp of each key is stored. Rows of the newest stamp of all are the newest of their key and do
    not move; only the older ones are joined, with the keys that have nothing newer.
    """
    newest = cut_lineage(df.groupBy(*key).agg(F.max(stamp).alias("_newest")))
    last = newest.agg(F.max("_newest")).scalar()
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    out, behind = df.filter(keyed & (F.col(stamp) == last)), newest.filter(F.col("_newest") < last)
    if behind.isEmpty():
        return out
    older = df.filter(F.col(stamp) < last).join(behind, list(key)).filter(F.col(stamp) == F.col("_newest"))
    return out.unionByName(older.select(df.columns))


def usable_odds_rows(odds: DataFrame) -> DataFrame:
    """Odds rows without empty or zero odds."""
    return odds.filter(F.col("odds").isNotNull() & (F.col("odds") != 0))


def read_log(spark: SparkSession, path: str, glob: str = "*.log") -> DataFrame:
    """Non-blank lines of the log files, with the file they come from."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return df.select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line")).filter("line <> ''")


def file_size_summary(spark: SparkSession, path: str, small_bytes: int = 1000) -> DataFrame:
    """Files, sizes and the share of suspiciously small ones per directory (listing only)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    size = F.col("length")
    return files.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("total_bytes"), F.avg(size).alias("mean_bytes"),
        F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"), F.count_if(size < small_bytes).alias("small_files"),
        F.avg((size < small_bytes).cast("int")).alias("small_rate"))


def quarantine_split(df: DataFrame, parser: str, source: str, raw_to_result: Mapping[str, str],
                     as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failure rows): a row fails for each field with text but no result."""
    failed = {raw: F.col(raw).isNotNull() & F.col(result).isNull() for raw, result in raw_to_result.items()}
    any_failed = F.lit(False)
    for f in failed.values():
        any_failed = any_failed | f
    errors = F.array_compact(F.array(*[
        F.when(f, F.struct(F.lit("unreadable").alias("error_type"),
                           F.concat(F.lit(f"{raw}: "), F.col(raw).cast("string")).alias("message")))
        for raw, f in failed.items()]))
    bad = df.filter(any_failed).select(F.lit(parser).alias("parser"), F.col(source).alias("source"),
                                       F.explode(errors).alias("e"))
    return df.filter(~any_failed), bad.select("parser", "source", "e.*", as_of.alias("failed_at"))


def repair_void_columns(df: DataFrame, keep: Mapping[str, str]) -> DataFrame:
    """Untyped all-NULL columns get the type in ``keep`` or are dropped."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    return df.withColumns({c: F.col(c).cast(keep[c]) for c in void if c in keep}).drop(*[c for c in void if c not in keep])


def manifest(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "feature string")


def manifest_diff(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Names (feature) listed but absent, and present but not listed."""
    return (listed.join(present, "feature", "left_anti").withColumn("state", F.lit("missing"))
            .unionByName(present.join(listed, "feature", "left_anti").withColumn("state", F.lit("extra"))))


def audit_rows(df: DataFrame, content: str, keep: Sequence[str]) -> DataFrame:
    """Audit columns for fetched content: sha256 and size."""
    data = F.col(content)
    return df.select(*keep, F.sha2(data, 256).alias("sha256"), F.octet_length(data).alias("size"))


def data_version(df: DataFrame, name: str, day: str) -> DataFrame:
    """Row count and date span of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).select(
        F.lit(name).alias("table"), "*")


def file_manifest(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """path, bytes and sha256 of every data file; contents are hashed where they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every data file, and the sum of their row hashes (equal rows do not cancel out)."""
    df = spark.read.parquet(path)
    row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.select(F.col("_metadata.file_path").alias("path"), row.alias("h")).groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("h").alias("fingerprint"))


BLOCK_ROWS = 1 << 20
FANOUT = 16


def _folded(members: Sequence[str | Column], rows: Column) -> list[Column]:
    """Row count and digest of a set of rows: two sums of 64-bit hashes, so that tasks combine them and no
    group is collected; ``members`` must tell the place too, which makes the digest depend on the order."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *members).cast("decimal(38,0)")) for seed in (1, 2)]
    return [rows.alias("rows"), F.sha2(F.concat_ws(" ", rows, *[s.cast("string") for s in sums]), 256).alias("digest")]


def block_manifest(spark: SparkSession, path: str, block_rows: int = BLOCK_ROWS, by_folder: bool = False) -> DataFrame:
    """(path, block, rows, digest) of every range of ``block_rows`` rows of every Parquet file below ``path``.

    A file is read in splits by many tasks, whatever its size; a row counts with its place and all its
    columns. Paths are relative to ``path``; with ``by_folder`` the file name is left out, for
    folders of one file each that are written anew under other names.
    """
    df = spark.read.parquet(path)
    inside = F.substring_index("_metadata.file_path", f"/{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    inside = F.regexp_replace(inside, "/?[^/]*$", "") if by_folder else inside
    names = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(inside.alias("path"), F.expr(f"_metadata.row_index div {int(block_rows)}").alias("block"),
                     F.xxhash64("_metadata.row_index", *[x for c in names for x in (c, c.isNull())]).alias("h"))
    return rows.groupBy("path", "block").agg(*_folded(["h"], F.count(F.lit(1))))


def hash_tree(blocks: DataFrame, levels: int = 4, fanout: int = FANOUT) -> DataFrame:
    """The blocks (level 0) and ``levels`` levels of nodes over ``fanout`` nodes each: (level, path, node, rows, digest).

    Each level is an aggregate of the one below, a ``fanout``-th of its size; store the result.
    """
    level = blocks.select(F.lit(0).alias("level"), "path", F.col("block").alias("node"), "rows", "digest")
    tree = level
    for n in range(1, levels + 1):
        parent = F.expr(f"node div {int(fanout)}")
        level = level.groupBy("path", parent.alias("up")).agg(*_folded(["node", "digest"], F.sum("rows"))).select(
            F.lit(n).alias("level"), "path", F.col("up").alias("node"), "rows", "digest")
        tree = tree.unionByName(level)
    return tree


def changed_blocks(old: DataFrame, new: DataFrame, levels: int = 4, fanout: int = FANOUT) -> DataFrame:
    """(path, block, state) of the blocks that differ between two stored trees: changed, added or removed.

    From the top down, only children of nodes that differ are compared; no data file is read.
    """
    def at(tree: DataFrame, level: int, name: str) -> DataFrame:
        return tree.filter(F.col("level") == level).select("path", "node", F.col("digest").alias(name))

    open_nodes = None
    for level in range(levels, -1, -1):
        sides = [at(old, level, "was"), at(new, level, "is")]
        if open_nodes is not None:
            up = open_nodes.withColumnRenamed("node", "up")
            sides = [s.withColumn("up", F.expr(f"node div {int(fanout)}")).join(up, ["path", "up"], "left_semi").drop("up") for s in sides]
        found = sides[0].join(sides[1], ["path", "node"], "full_outer").filter(~F.col("was").eqNullSafe(F.col("is")))
        open_nodes = found.select("path", "node")
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return found.select("path", F.col("node").alias("block"), state.alias("state"))
