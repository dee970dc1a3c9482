"""Profiles, validation checks and log summaries."""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, LOG_SQL, TIMELINE, entrants, hot_horses, log_lines, table, with_entrants
from raceflow.operators import logs, metrics, profile, sketches, timeline
from raceflow.registry import query
from raceflow.session import scratch_path
from raceflow.sources import files

K = "race_id, horse_id, jockey_id, bracket_number"
_PROFILED = ["race_id", "horse_id", "sex", "age", "prize_money", "venue", "win_odds"]
_TYPES = ["bigint", "bigint", "string", "int", "double", "string", "double"]


@query("column_profile", "A15", with_entrants(" UNION ALL ".join(f"""
  SELECT '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*), 6) AS null_rate,
         count(DISTINCT {c}) AS distinct_values, (count(*) - count({c})) / count(*) > 0.1 AS flagged FROM entrants"""
    for c, t in zip(_PROFILED, _TYPES))))
def column_profile(spark, sf):
    out = profile.column_profile(entrants(spark, sf, _PROFILED))
    return out.withColumn("null_rate", F.round("null_rate", 6))


@query("null_rate_by_family", "A15 P14", with_entrants("""
  SELECT family, count(*) AS columns, round(avg(rate), 6) AS mean_null_rate FROM (
    SELECT 'money' AS family, avg(CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END) AS rate FROM entrants
    UNION ALL SELECT 'age', avg(CASE WHEN age = 3 THEN 1 ELSE 0 END) FROM entrants
    UNION ALL SELECT 'other', avg(CASE WHEN popularity = 1 THEN 1 ELSE 0 END) FROM entrants) GROUP BY family"""))
def null_rate_by_family(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "age", "popularity"])
    df = df.withColumns({"age": F.when(F.col("age") != 3, F.col("age")),
                         "popularity": F.when(F.col("popularity") != 1, F.col("popularity"))})
    out = profile.family_null_rate(profile.column_profile(df), {"money": ["prize_", "money"], "age": ["age"]})
    return out.withColumn("mean_null_rate", F.round("mean_null_rate", 6))


_DESCRIBED = ["predicted_score", "finish_time_seconds", "prize_money"]


@query("describe_with_outliers", "A16", with_entrants(" UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std,
         min({c})::DOUBLE AS min, max(q1)::DOUBLE AS q1, max(q2)::DOUBLE AS median, max(q3)::DOUBLE AS q3, max({c})::DOUBLE AS max,
         count(*) FILTER ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS outliers
  FROM entrants CROSS JOIN (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
                                   quantile_cont({c}, 0.75) AS q3 FROM entrants)""" for c in _DESCRIBED)))
def describe_with_outliers(spark, sf):
    out = profile.describe_with_outliers(entrants(spark, sf, [*KEY, *_DESCRIBED]), _DESCRIBED)
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std")})


@query("group_size_distribution", "A17", """
  SELECT size, count(*) AS groups, size < 5 OR size > 20 AS abnormal FROM (
    SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) GROUP BY size""")
def group_size_distribution(spark, sf):
    return profile.group_sizes(table(spark, sf, "lineitem"), "l_orderkey")


@query("group_size_summary", "A17", """
  SELECT count(*) AS groups, round(avg(size), 6) AS mean, round(stddev_samp(size), 6) AS std, min(size) AS min,
         quantile_cont(size, 0.25)::DOUBLE AS q1, quantile_cont(size, 0.5)::DOUBLE AS median,
         quantile_cont(size, 0.75)::DOUBLE AS q3, max(size) AS max
  FROM (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1)""")
def group_size_summary(spark, sf):
    out = profile.size_summary(profile.group_sizes(table(spark, sf, "lineitem"), "l_orderkey"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("inconsistent_groups", "A18", """
  SELECT l_orderkey, count(DISTINCT l_returnflag) > 1 AS l_returnflag_varies,
         count(DISTINCT l_linestatus) > 1 AS l_linestatus_varies FROM lineitem GROUP BY 1
  HAVING count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1""")
def inconsistent_groups(spark, sf):
    return profile.inconsistent_groups(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("duplicate_profile", "A19", """
  WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem),
       f AS (SELECT *, count(*) AS n FROM t GROUP BY ALL),
       k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM t GROUP BY ALL)
  SELECT rows, full_duplicates, key_duplicates, key_duplicates - full_duplicates AS partial_duplicates, rows - key_duplicates AS unique_rows
  FROM (SELECT (SELECT count(*) FROM t) AS rows, (SELECT sum(n)::BIGINT FROM f WHERE n > 1) AS full_duplicates,
               (SELECT sum(n)::BIGINT FROM k WHERE n > 1) AS key_duplicates)""")
def duplicate_profile(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return profile.duplicate_profile(df, ["l_orderkey", "l_linenumber"])


@query("duplicate_multiplicity", "A19", """
  SELECT times, count(*) AS keys FROM (SELECT count(*) AS times FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  GROUP BY times""")
def duplicate_multiplicity(spark, sf):
    return profile.multiplicity(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_top_offenders", "A19", """
  SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1
  ORDER BY times DESC, l_orderkey, l_linenumber LIMIT 5""")
def duplicate_top_offenders(spark, sf):
    return profile.top_offenders(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_VARYING = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


@query("duplicate_varying_columns", "A19", " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count(*) FILTER (v > 1) AS keys FROM (
    SELECT count(DISTINCT {c}) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""" for c in _VARYING))
def duplicate_varying_columns(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_VARYING)
    return profile.varying_columns(df, ["l_orderkey", "l_linenumber"])


@query("duplication_ratio", "A20", """
  SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_returnflag) AS entities,
         round(count(*) / count(DISTINCT l_returnflag), 6) AS ratio FROM lineitem GROUP BY 1""")
def duplication_ratio(spark, sf):
    return profile.duplication_ratio(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag").withColumn(
        "ratio", F.round("ratio", 6))


@query("coverage_calendar", "A21", with_entrants("""
  SELECT year(race_date) AS year, month(race_date) AS month, count(*) AS rows, count(DISTINCT race_id) AS groups,
         count(DISTINCT race_date) AS days FROM entrants GROUP BY 1, 2"""))
def coverage_calendar(spark, sf):
    return profile.coverage_calendar(entrants(spark, sf, ["race_id", "race_date"]), "race_date", "race_id")


@query("null_rate_by_stratum", "A22", with_entrants("""
  SELECT career_starts, count(*) AS rows,
         round(avg(CASE WHEN prev IS NULL THEN 1 ELSE 0 END + CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END), 6) AS mean_nulls,
         round(avg(CASE WHEN prev IS NULL THEN 1 ELSE 0 END), 6) AS prev_prize_money_null_rate,
         round(avg(CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END), 6) AS prize_money_null_rate
  FROM (SELECT *, row_number() OVER h - 1 AS career_starts, lag(prize_money) OVER h AS prev FROM entrants
        WINDOW h AS (PARTITION BY horse_id ORDER BY race_date, race_id, jockey_id, bracket_number)) GROUP BY career_starts"""))
def null_rate_by_stratum(spark, sf):
    df = timeline.with_history(entrants(spark, sf, [*KEY, "race_date", "prize_money"]), ["horse_id"], TIMELINE,
                               timeline.start_count(), timeline.previous(["prize_money"]), hot=hot_horses(spark, sf))
    out = profile.null_rate_by(df, "career_starts", ["prev_prize_money", "prize_money"])
    return out.select("career_starts", "rows", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("value_counts", "A23", "SELECT p_type, count(*) AS count FROM part GROUP BY p_type")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_type")


@query("example_values", "A23", """
  SELECT p_brand, array_to_string(list_sort(list(p_size))[1:5], ',') AS examples
  FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY p_brand""")
def example_values(spark, sf):
    out = profile.examples(table(spark, sf, "part"), "p_brand", "p_size")
    return out.withColumn("examples", F.concat_ws(",", F.transform("examples", lambda x: x.cast("string"))))


def _results(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "finish_position"])
    return profile.validation_results({"races": df, "nations": table(spark, sf, "nation")},
                                      {"races": ["finish_position", "prize_money"], "nations": ["n_name"]})


_RESULTS_SQL = """
  SELECT 'races_rows' AS "check", 'pass' AS status, 'enough rows' AS message, count(*)::DOUBLE AS value FROM entrants
  UNION ALL SELECT 'races_missing', CASE WHEN v <= 0.1 THEN 'pass' ELSE 'warning' END,
    CASE WHEN v <= 0.1 THEN 'few missing values' ELSE 'many missing values' END, round(v, 6)
    FROM (SELECT avg(CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END) AS v FROM entrants)
  UNION ALL SELECT 'nations_rows', 'warning', 'too few rows', count(*)::DOUBLE FROM nation
  UNION ALL SELECT 'nations_missing', 'pass', 'few missing values', 0.0"""


@query("validation_results", "Q1", with_entrants(_RESULTS_SQL))
def validation_results(spark, sf):
    return _results(spark, sf).withColumn("value", F.round("value", 6))


@query("validation_summary", "Q1", with_entrants(f"SELECT status, count(*) AS checks FROM ({_RESULTS_SQL}) GROUP BY status"))
def validation_summary(spark, sf):
    return profile.status_summary(_results(spark, sf))


@query("schema_check", "Q2", """
  SELECT 'status_' || o_orderstatus AS "table", 'o_orderkey' AS "column", 'not numeric: string' AS issue FROM (SELECT DISTINCT o_orderstatus FROM orders)
  UNION ALL SELECT 'status_' || o_orderstatus, 'o_comment', 'missing' FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def schema_check(spark, sf):
    """A table for each order status, with its key read as text and a required column missing."""
    orders = table(spark, sf, "orders")
    out = None
    for status in sorted(r[0] for r in orders.select("o_orderstatus").distinct().collect()):  # a handful
        rows = orders.filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").cast("string"), "o_totalprice")
        issues = profile.schema_check(f"status_{status}", rows, ["o_orderkey", "o_comment"], ["o_orderkey", "o_totalprice"])
        out = issues if out is None else out.unionByName(issues)
    return out


@query("validation_limits", "Q1", with_entrants("""
  SELECT "check", CASE WHEN value <= bound THEN 'pass' ELSE 'warning' END AS status, round(value, 6) AS value FROM (
    SELECT 'scraping_status=' || o_orderstatus AS "check", CASE WHEN sum(length(CAST(o_orderkey AS VARCHAR)) + 1) < 5000 THEN 1.0 ELSE 0.0 END::DOUBLE AS value,
           0.01 AS bound FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'results_parse_errors', avg(CASE WHEN l_linenumber IN (3, 5) THEN 1.0 ELSE 0.0 END), 0.02 FROM lineitem
    """ + " ".join(f"""UNION ALL SELECT 'races_outliers_{c}', count(*) FILTER ({c} < q1 - 0.1 * (q3 - q1) OR {c} > q3 + 0.1 * (q3 - q1)) / count(*), 0.05
      FROM entrants, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM entrants)""" for c in ("win_odds", "age")) + ")"))
def validation_limits(spark, sf):
    """Small files, parse errors and outliers against their limits."""
    path = scratch_path(spark, "sizes")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("line"), F.col("o_orderstatus").alias("status"))
    orders.repartition("status").write.partitionBy("status").text(path)
    sizes = files.file_size_summary(spark, path, small_bytes=5000).filter("folder LIKE 'status=%'")
    raw = F.when(F.col("l_linenumber").isin(3, 5), "---").otherwise(F.col("l_linenumber").cast("string"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", raw.alias("finish")).withColumn("n", F.col("finish").try_cast("int"))
    good, bad = files.quarantine_split(lines, "results", "l_orderkey", {"finish": "n"}, F.current_timestamp())
    races = entrants(spark, sf, ["win_odds", "age"])
    out = profile.file_results(sizes).unionByName(profile.parse_results(good, bad, "results")).unionByName(
        profile.outlier_results(profile.describe_with_outliers(races, ["win_odds", "age"], spread=0.1), "races"))
    return out.select("check", "status", F.round("value", 6).alias("value"))


@query("consistency_checks", "Q3", with_entrants("""
  SELECT 'finish_beyond_field' AS rule, count(*) FILTER (finish_position > head_count) AS violations FROM entrants
  UNION ALL SELECT 'distance_m_out_of_range', count(*) FILTER (distance_m < 100 OR distance_m > 4000) FROM entrants
  UNION ALL SELECT 'finish_time_seconds_out_of_range', count(*) FILTER (finish_time_seconds < 50 OR finish_time_seconds > 500)
    FROM entrants"""))
def consistency_checks(spark, sf):
    return profile.consistency_checks(entrants(spark, sf, [*KEY, "finish_position", "head_count", "distance_m",
                                                           "finish_time_seconds"]))


@query("feature_checks", "Q4", with_entrants("""
  SELECT 'age' AS "column", false AS forbidden, 0.0::DOUBLE AS null_rate, 0 AS nans, 0 AS infinite, false AS too_many_nulls
  UNION ALL SELECT 'prize_money', true, round(avg(CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END), 6), 0, 0,
    avg(CASE WHEN prize_money IS NULL THEN 1 ELSE 0 END) > 0.1 FROM entrants
  UNION ALL SELECT 'ratio', false, 0.0, count(*) FILTER (bracket_number = 2), count(*) FILTER (bracket_number IN (1, 3)), false
    FROM entrants"""))
def feature_checks(spark, sf):
    df = entrants(spark, sf, [*KEY, "age", "prize_money"])
    b = F.col("bracket_number")
    ratio = (F.when(b == 1, float("inf")).when(b == 3, float("-inf")).when(b == 2, float("nan")).otherwise(F.lit(1.5)))
    out = profile.feature_checks(df.select("age", "prize_money", ratio.alias("ratio")))
    return out.withColumn("null_rate", F.round("null_rate", 6))


def _log(spark, sf):
    return logs.parsed(log_lines(spark, sf))


@query("log_counts_by_level_and_module", "Q5", f"WITH {LOG_SQL} SELECT level, module, count(*) AS lines FROM log GROUP BY ALL")
def log_counts(spark, sf):
    return logs.counts_by(_log(spark, sf), "level", "module")


@query("log_outcomes", "Q5", f"""WITH {LOG_SQL}, m AS (SELECT lower(message) AS m FROM log)
  SELECT stage, subject, outcome, count(*) AS lines FROM (
    SELECT stage, subject, CASE WHEN m LIKE '%success%' OR m LIKE '%completed%' THEN 'done'
             WHEN m LIKE '%failed%' OR m LIKE '%error%' THEN 'failed'
             WHEN m LIKE '%skip%' AND stage = 'scraping' THEN 'skipped' END AS outcome
    FROM m, (VALUES ('scraping', '%scraping%'), ('parsing', '%pars%')) s(stage, sp),
         (VALUES ('races', '%race%'), ('shutuba', '%shutuba%'), ('horses', '%horse%'), ('pedigrees', '%pedigree%')) u(subject, up)
    WHERE m LIKE sp AND m LIKE up AND NOT (subject = 'horses' AND m LIKE '%pedigree%'))
  WHERE outcome IS NOT NULL GROUP BY ALL""")
def log_outcomes(spark, sf):
    return logs.outcomes(_log(spark, sf))


@query("log_http_codes", "Q5", rf"""WITH {LOG_SQL} SELECT code, count(*) AS lines FROM (
  SELECT regexp_extract(lower(message), 'https?\s+(\d{{3}})', 1) AS code FROM log) WHERE code <> '' GROUP BY code""")
def log_http_codes(spark, sf):
    return logs.http_codes(_log(spark, sf))


@query("log_missing_fields", "Q5", rf"""WITH {LOG_SQL} SELECT field, count(*) AS lines FROM (
  SELECT regexp_extract(lower(message), 'missing\s+fields?:\s*(\w+)', 1) AS field FROM log) WHERE field <> ''
  GROUP BY field ORDER BY lines DESC, field LIMIT 15""")
def log_missing_fields(spark, sf):
    return logs.missing_fields(_log(spark, sf))


@query("log_fields_not_found", "Q5", f"""WITH {LOG_SQL} SELECT split_part(message, ' ', 1) AS field, count(*) AS lines
  FROM log WHERE message LIKE '% not found' GROUP BY 1""")
def log_fields_not_found(spark, sf):
    return logs.not_found(_log(spark, sf))


@query("log_stage_durations", "Q5", rf"""WITH {LOG_SQL}
  SELECT stage, max_by(seconds, (logged_at, event_id)) AS seconds FROM (
    SELECT CASE WHEN message LIKE '%parsing%' THEN 'parsing' ELSE 'total_pipeline' END AS stage, logged_at, event_id,
      TRY_CAST(regexp_extract(message, 'completed in\s+([\d.]+)\s+seconds?', 1) AS DOUBLE) AS seconds FROM log)
  WHERE seconds IS NOT NULL GROUP BY stage""")
def log_stage_durations(spark, sf):
    return logs.stage_durations(_log(spark, sf), "event_id")


@query("log_throughput", "Q5", rf"""WITH {LOG_SQL}
  SELECT 'scraping' AS stage, round(avg(CAST(regexp_extract(message, '(\d+) items in (\d+)', 1) AS DOUBLE)
    / CAST(regexp_extract(message, '(\d+) items in (\d+)', 2) AS DOUBLE)), 6) AS items_per_second
  FROM log WHERE message LIKE '%items in%'""")
def log_throughput(spark, sf):
    return logs.throughput(_log(spark, sf)).withColumn("items_per_second", F.round("items_per_second", 6))


@query("log_retries", "Q6", f"WITH {LOG_SQL} SELECT count(*) FILTER (message LIKE '%retry%') AS retries FROM log")
def log_retries(spark, sf):
    return logs.retries(_log(spark, sf))


@query("log_latest_errors", "Q6", f"""WITH {LOG_SQL} SELECT event_id, module, level, message FROM log WHERE level = 'ERROR'
  ORDER BY logged_at DESC, event_id DESC LIMIT 20""")
def log_latest_errors(spark, sf):
    return logs.latest(_log(spark, sf), "ERROR", "event_id").drop("logged_at")


_METRIC_SQL = """SELECT event_type AS metric, CAST(ts AS DATE) AS run, avg(value) AS value FROM events GROUP BY ALL"""


@query("metric_history_alerts", "Q7", f"""
  SELECT metric, CAST(run AS STRING) AS run, runs_before, round(baseline, 6) AS baseline,
         CASE WHEN runs_before < 5 THEN 'learning' WHEN abs(value - baseline) > 3 * s THEN 'critical'
              WHEN abs(value - baseline) > 2 * s THEN 'warning' ELSE 'ok' END AS severity
  FROM (SELECT *, avg(value) OVER w AS baseline, stddev_samp(value) OVER w AS s, count(value) OVER w AS runs_before
        FROM ({_METRIC_SQL}) WINDOW w AS (PARTITION BY metric ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def metric_history_alerts(spark, sf):
    history = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("metric"), F.col("ts").cast("date").alias("run")).agg(F.avg("value").alias("value"))
    out = profile.metric_alerts(history, "metric", "run", "value")
    return out.select("metric", F.col("run").cast("string").alias("run"), "runs_before",
                      F.round("baseline", 6).alias("baseline"), "severity")


_ADVISED = """CASE metric
    WHEN 'spearman_mean' THEN CASE WHEN value > -0.3 THEN 'weak ranking: review features and model'
      WHEN value > -0.5 THEN 'moderate ranking: features can be improved' ELSE 'good ranking' END
    WHEN 'brier_score' THEN CASE WHEN value > 0.25 THEN 'high Brier score: calibrate probabilities' END
    WHEN 'ece' THEN CASE WHEN value > 0.1 THEN 'probabilities are not calibrated' END
    WHEN 'roi' THEN CASE WHEN value < 0 THEN 'negative return: review the betting rule' WHEN value > 10 THEN 'good return' END
    WHEN 'worst_segment' THEN CASE WHEN value > -0.3 THEN 'weak segment: add features or data for it' END
    WHEN 'worst_races' THEN CASE WHEN value > 0 THEN 'races with especially weak predictions: look for what they share' END END"""


@query("recommendations", "Q8", with_entrants(f"""
  SELECT metric, round(value, 5) AS value, {_ADVISED} AS advice FROM (
    SELECT metric, value * scale AS value FROM (
      SELECT 'brier_score' AS metric, avg(pow(win_probability - is_win, 2)) AS value FROM entrants
      UNION ALL SELECT 'roi', (sum(is_win * win_odds) - count(*)) * 100 / count(*) FROM entrants
      UNION ALL SELECT 'spearman_mean', -avg(is_win) FROM entrants
      UNION ALL SELECT 'ece', avg(is_win) FROM entrants
      UNION ALL SELECT 'worst_segment', -avg(is_win) FROM entrants
      UNION ALL SELECT 'worst_races', count(*) FILTER (finish_position > 5) / count(*) FROM entrants),
      (SELECT unnest([0.0, 0.4, 1.0, 2.0, 4.0]) AS scale))
  WHERE {_ADVISED} IS NOT NULL"""))
def recommendations(spark, sf):
    """Every rule of the table meets values on both sides of its limit (each metric at five scales)."""
    df = entrants(spark, sf, [*KEY, "win_probability", "is_win", "win_odds", "finish_position"])
    won = F.avg("is_win")
    wide = df.agg(metrics.brier("win_probability", "is_win").alias("brier_score"),
                  ((F.sum(F.col("is_win") * F.col("win_odds")) - F.count(F.lit(1))) * 100 / F.count(F.lit(1))).alias("roi"),
                  (-won).alias("spearman_mean"), won.alias("ece"), (-won).alias("worst_segment"),
                  (F.count_if(F.col("finish_position") > 5) / F.count(F.lit(1))).alias("worst_races"))
    long = wide.unpivot([], wide.columns, "metric", "value")
    scales = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.4, 1.0, 2.0, 4.0)])).alias("scale")
    long = long.select("metric", "value", scales).select("metric", (F.col("value") * F.col("scale")).alias("value"))
    return profile.recommendations(long).withColumn("value", F.round("value", 5))


@query("validation_report", "Q9", with_entrants(f"""
  SELECT row_number() OVER (ORDER BY o, text) AS line, text FROM (
    SELECT '# Validation: ' || count(*) || ' checks' AS text, 1 AS o FROM ({_RESULTS_SQL})
    UNION ALL SELECT '- **' || status || '** ' || "check" || ': ' || message || ' (' || format('{{:,.4f}}', value) || ')',
      CASE status WHEN 'fail' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END FROM ({_RESULTS_SQL}))"""))
def validation_report(spark, sf):
    return profile.report_lines(_results(spark, sf), "Validation")


# ---- profiles from stored sketches ---------------------------------------------

_SKETCHED = {"horse_id": True, "trainer_id": True, "track_surface": False, "finish_time_seconds": True}
_MIDDLE = "CASE WHEN b = 0 THEN 0 ELSE sign(b) * 2 * pow(1.01 / 0.99, abs(b) - 1048576) / (1.01 / 0.99 + 1) END"
_AT = ", ".join(f"greatest(low, least(high, max({_MIDDLE}) FILTER (r = ceil({p} * count)))) AS p{100 * p:g}" for p in (0.25, 0.5, 0.75))


@query("profile_from_monthly_sketches", "A15 A16 Q7", with_entrants("").rstrip() + ", v AS (" + " UNION ALL ".join(f"""
    SELECT year(race_date) AS year, '{c}' AS "column", CAST({c} AS VARCHAR) AS value, {f"CAST({c} AS DOUBLE)" if number else "NULL::DOUBLE"} AS x
    FROM entrants""" for c, number in _SKETCHED.items()) + f"""), registers AS (
    SELECT year, "column", ('0x' || substr(md5(value), 1, 3))::BIGINT AS slot, min(('0x' || substr(md5(value), 4, 12))::BIGINT) AS least
    FROM v WHERE value IS NOT NULL GROUP BY ALL), d AS (
    SELECT year, "column", 4096.0 * count(*) / (sum((least + 1) / 281474976710656.0::DOUBLE) + 4096 - count(*)) AS "distinct"
    FROM registers GROUP BY ALL), ranked AS (
    SELECT year, "column", x, row_number() OVER (PARTITION BY year, "column" ORDER BY x) AS r,
           CASE WHEN x = 0 THEN 0 ELSE sign(x) * (ceil(ln(abs(x)) / ln(1.01 / 0.99)) + 1048576) END AS b,
           count(*) OVER g AS count, min(x) OVER g AS low, max(x) OVER g AS high
    FROM v WHERE x IS NOT NULL WINDOW g AS (PARTITION BY year, "column")), q AS (
    SELECT year, "column", avg(x) AS mean, stddev_samp(x) AS deviation, low, high, {_AT} FROM ranked GROUP BY year, "column", count, low, high)
  SELECT year, "column", t.rows, t.nulls, round("distinct", 4) AS "distinct", round(mean, 4) AS mean, round(deviation, 4) AS deviation,
         low, high, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75
  FROM (SELECT year, "column", count(*) AS rows, count(*) - count(value) AS nulls FROM v GROUP BY ALL) t
  LEFT JOIN d USING (year, "column") LEFT JOIN q USING (year, "column")""")
def profile_from_monthly_sketches(spark, sf):
    """Yearly profiles merged from the sketches of each month, as stored."""
    rows = entrants(spark, sf, ["race_date", *_SKETCHED]).withColumn("month", F.date_format("race_date", "yyyy-MM"))
    path = scratch_path(spark, "sketches")
    sketches.store(sketches.sketch(rows, "month", list(_SKETCHED)), path)
    kept = sketches.stored(spark, path).withColumn("year", F.substring("period", 1, 4).cast("int"))
    out = sketches.profile(kept, by=["year"])
    return out.withColumns({c: F.round(c, 4) for c in ("distinct", "mean", "deviation", "p25", "p50", "p75")})
