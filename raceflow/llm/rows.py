"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``; a null key counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def gapless(df: DataFrame, rows: int, group: str, chunk_on: Column, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each group 0, 1, 2, … without bringing a group into one task.

    Rows are dealt into chunks by a hash, numbered within the chunk and moved up by the
    rows of earlier chunks. ``rows`` is the row count of ``df``, which should be stored.
    """
    chunks = max(1, rows // CHUNK_ROWS)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(chunk_on), F.lit(chunks)))
    counts = dealt.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_chunk").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(within) - F.lit(1))
    return (numbered.join(offsets, [group, "_chunk"])
            .withColumn(out, F.col("_before") + F.col("_at")).drop("_chunk", "_before", "_at"))


HEAVY = 1_000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], many: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key; ``many`` is the key's row count in ``rows``).

    Keys of more than ``total / HEAVY`` rows are fewer than ``HEAVY``: they are broadcast, so
    that their rows stay where they are; the rows of all others are shuffled. Both should be stored.
    """
    heavy = F.col(many) * HEAVY > total
    flagged = rows.join(F.broadcast(table.filter(heavy).withColumn("_heavy", F.lit(True))), keys, "left")
    rest = flagged.filter("_heavy IS NULL").select(rows.columns).join(table.filter(~heavy), keys, "left")
    return flagged.filter("_heavy").drop("_heavy").unionByName(rest)
