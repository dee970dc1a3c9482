"""Summaries of parsed log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow.functions.text import log_line

# Words and patterns, looked for in the lower-cased message.
SUBJECTS = {"pedigrees": "pedigree", "horses": "horse", "shutuba": "shutuba", "races": "race"}
STAGES = {"scraping": "scraping", "parsing": "pars"}
TIMED_STAGES = {"scraping": "scraping", "parsing": "parsing", "total_pipeline": "pipeline"}
HTTP_CODE = r"http[s]?\s+(\d{3})"
MISSING_FIELD = r"missing\s+field[s]?:\s*(\w+)"
NOT_FOUND = r"(distance|surface|weather|venue|class).*not found"
DURATION = r"completed in\s+([\d.]+)\s+seconds?"
THROUGHPUT = r"(\d+)\s+items?\s+in\s+([\d.]+)\s+seconds?"


def parsed(lines: DataFrame, line: str = "line", with_module: bool = True) -> DataFrame:
    """Structured log rows; lines of another shape are left out."""
    rest = [c for c in lines.columns if c != line]
    return (lines.withColumn("_p", log_line(F.col(line), with_module)).filter(F.col("_p").isNotNull())
            .select(*rest, "_p.*"))


def _has(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def counts_by(log: DataFrame, *columns: str) -> DataFrame:
    return log.groupBy(*columns).agg(F.count(F.lit(1)).alias("lines"))


def outcomes(log: DataFrame) -> DataFrame:
    """Lines per stage, subject and outcome. A message can count for several subjects;
    skipping is an outcome of scraping only."""
    m = F.lower("message")
    outcome = (F.when(_has(m, "success", "completed"), "done").when(_has(m, "failed", "error"), "failed")
               .when(_has(m, "skip") & (F.col("stage") == "scraping"), "skipped"))
    stages = F.explode(F.array_compact(F.array(*[F.when(m.contains(w), s) for s, w in STAGES.items()]))).alias("stage")
    pedigree = m.contains("pedigree")
    subjects = F.explode(F.array_compact(F.array(*[
        F.when(m.contains(w) & (~pedigree if s == "horses" else F.lit(True)), s) for s, w in SUBJECTS.items()]))).alias("subject")
    rows = log.select("message", stages).select("message", "stage", subjects).withColumn("outcome", outcome)
    return rows.filter("outcome IS NOT NULL").groupBy("stage", "subject", "outcome").agg(F.count(F.lit(1)).alias("lines"))


def http_codes(log: DataFrame) -> DataFrame:
    code = F.regexp_extract(F.lower("message"), HTTP_CODE, 1)
    return log.select(code.alias("code")).filter("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("lines"))


def missing_fields(log: DataFrame, n: int = 15) -> DataFrame:
    """Most often missing fields."""
    field = F.regexp_extract(F.lower("message"), MISSING_FIELD, 1)
    return (log.select(field.alias("field")).filter("field <> ''").groupBy("field")
            .agg(F.count(F.lit(1)).alias("lines")).orderBy(F.desc("lines"), "field").limit(n))


def not_found(log: DataFrame) -> DataFrame:
    field = F.regexp_extract(F.lower("message"), NOT_FOUND, 1)
    return log.select(field.alias("field")).filter("field <> ''").groupBy("field").agg(F.count(F.lit(1)).alias("lines"))


def retries(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(_has(F.lower("message"), "retry")).alias("retries"))


def _timed_stage(message: Column) -> Column:
    """First stage of the table that the message names, or NULL."""
    return F.coalesce(*[F.when(message.contains(w), s) for s, w in TIMED_STAGES.items()])


def stage_durations(log: DataFrame, order: str) -> DataFrame:
    """Last reported duration per stage."""
    m = F.lower("message")
    seconds = F.regexp_extract(m, DURATION, 1).try_cast("double")
    stage = F.coalesce(_timed_stage(m), F.lit("other"))
    return (log.select(stage.alias("stage"), seconds.alias("seconds"), "logged_at", order).filter("seconds IS NOT NULL")
            .groupBy("stage").agg(F.max_by("seconds", F.struct("logged_at", order)).alias("seconds")))


def throughput(log: DataFrame) -> DataFrame:
    """Mean items per second of scraping and parsing."""
    m = F.lower("message")
    items, seconds = (F.regexp_extract(m, THROUGHPUT, i).try_cast("double") for i in (1, 2))
    rate = F.coalesce(F.try_divide(items, seconds), F.lit(0.0))
    return (log.filter(m.rlike(THROUGHPUT) & F.col("logged_at").isNotNull())
            .select(_timed_stage(m).alias("stage"), rate.alias("rate")).filter(F.col("stage").isin(*STAGES))
            .groupBy("stage").agg(F.avg("rate").alias("items_per_second")))


def latest(log: DataFrame, level: str, order: str, n: int = 20) -> DataFrame:
    return log.filter(F.col("level") == level).orderBy(F.desc("logged_at"), F.desc(order)).limit(n)
