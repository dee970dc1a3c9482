"""Web pages: stored bytes to text, and the ids in their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHARSET_CONF = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def read_pages(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: path, size, modification time and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path)


def with_page_text(pages: DataFrame, content: str, out: str) -> DataFrame:
    """EUC-JP text when the bytes are EUC-JP, else UTF-8; bad bytes are replaced.

    Bytes that survive decoding and encoding again were in that charset. The two
    settings are read while the plan is analysed, so they are restored right after.
    """
    spark = pages.sparkSession
    before = {k: spark.conf.get(k, "false") for k in _CHARSET_CONF}
    for k in _CHARSET_CONF:
        spark.conf.set(k, "true")
    try:
        data = F.col(content)
        japanese = F.decode(data, "EUC-JP")
        return pages.withColumn(out, F.when(F.encode(japanese, "EUC-JP") == data, japanese)
                                .otherwise(F.decode(data, "UTF-8")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def link_ids(pages: DataFrame, html: str, pattern: str) -> DataFrame:
    """One row per match of the pattern's group in each page, ``id`` beside the other columns."""
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), 1)).alias("id"))
