"""Evaluation, backtest and return-series reports."""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, entrants, hot_races, table, with_entrants
from raceflow.functions import bands
from raceflow.operators import ingroup, metrics
from raceflow.registry import query

K = "race_id, horse_id, jockey_id, bracket_number"


def spearman_sql(source, keys, a, b, carry=""):
    """Oracle text: rank correlation per ``keys`` over ``source``."""
    def ranked(c):
        return (f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) "
                f"+ CAST(count(*) OVER (PARTITION BY {keys}, {c}) - 1 AS DOUBLE) / 2")
    return f"""SELECT {keys}, n{', ' + ', '.join(c.split(' AS ')[1] for c in carry.split(';')) if carry else ''},
      CASE WHEN (n * sxx - sx * sx) * (n * syy - sy * sy) > 0
           THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END AS correlation
      FROM (SELECT {keys}, count(*) AS n, sum(ra) AS sx, sum(rb) AS sy, sum(ra * rb) AS sxy, sum(ra * ra) AS sxx,
                   sum(rb * rb) AS syy{', ' + ', '.join(carry.split(';')) if carry else ''}
            FROM (SELECT *, {ranked(a)} AS ra, {ranked(b)} AS rb FROM {source}) GROUP BY {keys})"""


_RACE_CORR = spearman_sql("entrants", "race_id", "predicted_score", "finish_position")


def _scored(spark, sf, *more):
    return entrants(spark, sf, [*KEY, "predicted_score", "finish_position", *more])


@query("spearman_per_race", "A24", with_entrants(f"SELECT race_id, n, round(correlation, 9) AS correlation FROM ({_RACE_CORR})"))
def spearman_per_race(spark, sf):
    out = metrics.spearman(_scored(spark, sf), ["race_id"], "predicted_score", "finish_position",
                           hot=hot_races(spark, sf))
    return out.withColumn("correlation", F.round("correlation", 9))


@query("spearman_summary", "A24", with_entrants(f"""
  SELECT round(avg(correlation), 8) AS spearman_mean, round(quantile_cont(correlation, 0.5), 8) AS spearman_median,
         round(stddev_pop(correlation), 8) AS spearman_std FROM ({_RACE_CORR})"""))
def spearman_summary(spark, sf):
    out = metrics.correlation_summary(metrics.spearman(
        _scored(spark, sf), ["race_id"], "predicted_score", "finish_position", hot=hot_races(spark, sf)))
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("rmse_and_brier", "A25", with_entrants("""
  SELECT round(sqrt(avg(pow(predicted_time - finish_time_seconds, 2))), 6) AS rmse,
         round(avg(pow(win_probability - is_win, 2)), 8) AS brier FROM entrants"""))
def rmse_and_brier(spark, sf):
    df = entrants(spark, sf, [*KEY, "predicted_time", "finish_time_seconds", "win_probability", "is_win"])
    return df.agg(F.round(metrics.rmse("finish_time_seconds", "predicted_time"), 6).alias("rmse"),
                  F.round(metrics.brier("win_probability", "is_win"), 8).alias("brier"))


@query("expected_calibration_error", "A26", with_entrants("""
  SELECT round(sum(n * gap) / sum(n), 8) AS ece FROM (
    SELECT least(floor(round(win_probability, 7) * 10), 9) AS bin, count(*) AS n,
           abs(avg(round(win_probability, 7)) - avg(is_win)) AS gap FROM entrants GROUP BY 1)"""))
def expected_calibration_error(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability", "is_win"])
    df = df.withColumn("win_probability", F.round("win_probability", 7))
    return metrics.calibration_error(df, "win_probability", "is_win").select(F.round("ece", 8).alias("ece"))


@query("calibration_table", "A27", with_entrants("""
  SELECT bin, round(avg(p), 7) AS mean_probability, round(avg(is_win), 7) AS hit_rate, count(*) AS rows,
         round(avg(p) - avg(is_win), 7) AS error
  FROM (SELECT p, is_win, len(list_filter(list_distinct(edges), lambda e: p > e)) AS bin FROM (
    SELECT round(win_probability, 7) AS p, is_win FROM entrants) CROSS JOIN (
    SELECT quantile_cont(round(win_probability, 7), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM entrants))
  GROUP BY bin"""))
def calibration_table(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability", "is_win"])
    df = df.withColumn("win_probability", F.round("win_probability", 7))
    out = metrics.calibration_table(df, "win_probability", "is_win")
    return out.select("bin", *[F.round(c, 7).alias(c) for c in ("mean_probability", "hit_rate", "error")], "rows")


@query("top_k_overlap", "A28", with_entrants(" UNION ALL ".join(f"""
  SELECT {k} AS k, count(*) AS races, round(avg(hit), 7) AS accuracy FROM (
    SELECT race_id, max(CASE WHEN p <= {k} AND finish_position <= {k} THEN 1 ELSE 0 END) AS hit FROM (
      SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY predicted_score, horse_id, jockey_id, bracket_number) AS p
      FROM entrants) GROUP BY race_id HAVING count(*) >= {k})""" for k in (1, 3, 5))))
def top_k_overlap(spark, sf):
    out = metrics.top_k_overlap(_scored(spark, sf), "race_id", KEY[1:], "predicted_score", "finish_position", [1, 3, 5],
                                hot_races(spark, sf))
    return out.withColumn("accuracy", F.round("accuracy", 7))


@query("fractional_top_roi", "A29", with_entrants("""
  SELECT count(*) AS bets, sum(CASE WHEN finish_position = 1 THEN win_odds ELSE 0 END) AS returned,
         round((sum(CASE WHEN finish_position = 1 THEN win_odds ELSE 0 END) - count(*)) * 100 / count(*), 6) AS roi
  FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY predicted_score, horse_id, jockey_id, bracket_number) AS p
        FROM entrants) WHERE p <= greatest(1, floor(head_count * 0.2))"""))
def fractional_top_roi(spark, sf):
    out = metrics.fractional_top_roi(_scored(spark, sf, "win_odds"), "race_id", ["predicted_score", *KEY[1:]],
                                     hot=hot_races(spark, sf))
    return out.withColumn("roi", F.round("roi", 6))


@query("daily_evaluation", "A30 A25", with_entrants(f"""
  SELECT CAST(race_date AS STRING) AS race_date, round(rmse, 6) AS rmse, round(spearman_corr, 6) AS spearman_corr,
         round(hit_rate, 6) AS hit_rate, race_count, total_bet, total_return, round(total_return / total_bet, 6) AS recovery_rate
  FROM (SELECT race_date, coalesce(avg(correlation), 0) AS spearman_corr,
          avg(CASE WHEN finish_position <= 3 THEN 1 ELSE 0 END) AS hit_rate, count(*) AS race_count, count(*) * 100 AS total_bet,
          sum(CASE WHEN finish_position = 1 THEN 100 * win_odds ELSE 0 END) AS total_return
        FROM ({_RACE_CORR}) JOIN (SELECT *, row_number() OVER (PARTITION BY race_id
          ORDER BY predicted_score, horse_id, jockey_id, bracket_number) AS p FROM entrants) USING (race_id)
        WHERE p = 1 AND n > 1 GROUP BY race_date)
  JOIN (SELECT race_date, sqrt(avg(pow(predicted_score - finish_time_seconds, 2))) AS rmse FROM entrants GROUP BY 1)
  USING (race_date)"""))
def daily_evaluation(spark, sf):
    df = _scored(spark, sf, "win_odds", "race_date", "finish_time_seconds")
    out = metrics.daily_evaluation(df, "race_id", "race_date", KEY[1:], "predicted_score", hot=hot_races(spark, sf))
    return out.select(F.col("race_date").cast("string").alias("race_date"), "race_count", "total_bet", "total_return",
                      *[F.round(c, 6).alias(c) for c in ("rmse", "spearman_corr", "hit_rate", "recovery_rate")])


_T = "[0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35]"


@query("threshold_sweep", "A31", with_entrants(f"""
  SELECT t::DOUBLE AS threshold, count(*) AS races, sum(is_win)::BIGINT AS wins, round(avg(is_win), 7) AS win_rate,
         round(avg(is_win * win_odds), 7) AS roi
  FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(win_probability, 7) DESC, horse_id, jockey_id,
          bracket_number) AS r FROM entrants), (SELECT unnest({_T}) AS t)
  WHERE r = 1 AND round(win_probability, 7) >= t GROUP BY t"""))
def threshold_sweep(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability", "is_winner", "win_odds"])
    df = df.withColumn("win_probability", F.round("win_probability", 7))
    out = metrics.threshold_sweep(df, "race_id", KEY[1:], [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35])
    return out.select("threshold", "races", "wins", F.round("win_rate", 7).alias("win_rate"), F.round("roi", 7).alias("roi"))


@query("best_threshold", "A31", with_entrants(f"""
  SELECT t::DOUBLE AS threshold, count(*) AS races, round(avg(is_win * win_odds), 7) AS roi
  FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(win_probability, 7) DESC, horse_id, jockey_id,
          bracket_number) AS r FROM entrants), (SELECT unnest({_T}) AS t)
  WHERE r = 1 AND round(win_probability, 7) >= t GROUP BY t ORDER BY roi DESC, threshold LIMIT 1"""))
def best_threshold(spark, sf):
    return metrics.best_threshold(threshold_sweep(spark, sf)).select("threshold", "races", "roi")


_HALF_OPEN = ("CASE WHEN distance_m < 1400 THEN 'sprint' WHEN distance_m < 1800 THEN 'mile' WHEN distance_m < 2200 "
              "THEN 'intermediate' WHEN distance_m < 2800 THEN 'long' ELSE 'extended' END")


@query("segment_report", "A32", with_entrants(f"""
  SELECT segment, value, CAST(sum(n) AS BIGINT) AS rows, round(avg(correlation), 7) AS spearman_mean,
         round(stddev_pop(correlation), 7) AS spearman_std FROM (""" + spearman_sql("""(
    SELECT race_id, predicted_score, finish_position, 'distance' AS segment, """ + _HALF_OPEN + """ AS value FROM entrants
    UNION ALL SELECT race_id, predicted_score, finish_position, 'track_surface', track_surface FROM entrants
    UNION ALL SELECT race_id, predicted_score, finish_position, 'venue', venue FROM entrants)""",
    "segment, value, race_id", "predicted_score", "finish_position") + """)
  GROUP BY segment, value HAVING sum(n) >= 10 AND avg(correlation) IS NOT NULL"""))
def segment_report(spark, sf):
    df = _scored(spark, sf, "distance_m", "track_surface", "venue")
    out = metrics.segment_report(df, "race_id", {
        "distance": bands.distance_half_open(F.col("distance_m"), "extended"),
        "track_surface": F.col("track_surface"), "venue": F.col("venue")}, "predicted_score", "finish_position")
    return out.select("segment", "value", "rows", F.round("spearman_mean", 7).alias("spearman_mean"),
                      F.round("spearman_std", 7).alias("spearman_std"))


@query("worst_races", "A33", with_entrants(f"""
  SELECT race_id, n, round(correlation, 9) AS correlation FROM ({_RACE_CORR}) WHERE correlation > -0.3
  ORDER BY correlation DESC, race_id LIMIT 20"""))
def worst_races(spark, sf):
    corr = metrics.spearman(_scored(spark, sf), ["race_id"], "predicted_score", "finish_position", hot=hot_races(spark, sf))
    return metrics.worst_groups(corr, "race_id").withColumn("correlation", F.round("correlation", 9))


@query("error_distribution", "A33", with_entrants("""
  SELECT segment, value, races FROM (WITH weak AS (SELECT venue, CASE WHEN metres <= 1400 THEN 'sprint' WHEN metres <= 1800 THEN 'mile'
                  WHEN metres <= 2200 THEN 'intermediate' ELSE 'long' END AS band FROM (""" + spearman_sql(
    "entrants", "race_id", "predicted_score", "finish_position", "min(venue) AS venue;min(distance_m) AS metres")
    + """) WHERE correlation > -0.3)
  SELECT 'venue' AS segment, venue AS value, count(*) AS races FROM weak GROUP BY venue
  UNION ALL SELECT 'band', band, count(*) FROM weak GROUP BY band)"""))
def error_distribution(spark, sf):
    df = _scored(spark, sf, "venue", "distance_m")
    corr = metrics.spearman(df, ["race_id"], "predicted_score", "finish_position",
                            {"venue": F.min("venue"), "metres": F.min("distance_m")}, hot_races(spark, sf))
    band = bands.right_closed(F.col("metres"), [(1400, "sprint"), (1800, "mile"), (2200, "intermediate"), (5000, "long")])
    return metrics.error_distribution(corr.withColumn("band", band), ["venue", "band"])


@query("popularity_groups", "A34", with_entrants("""
  SELECT CASE WHEN popularity <= 3 THEN 'favourites' WHEN popularity <= 6 THEN 'middle' ELSE 'outsiders' END AS popularity_group,
         round(avg(win_probability), 7) AS mean_probability, round(avg(is_win), 7) AS hit_rate, count(*) AS rows
  FROM entrants WHERE popularity <= 20 GROUP BY 1"""))
def popularity_groups(spark, sf):
    df = entrants(spark, sf, [*KEY, "popularity", "win_probability", "is_win"])
    out = metrics.by_popularity(df, "popularity", "win_probability", "is_win")
    return out.select("popularity_group", "rows", F.round("mean_probability", 7).alias("mean_probability"),
                      F.round("hit_rate", 7).alias("hit_rate"))


@query("confidence_groups", "A34", with_entrants("""
  SELECT CASE WHEN last_3f_time > b THEN 'low' WHEN last_3f_time > a THEN 'medium' ELSE 'high' END AS confidence,
         round(avg(win_probability), 7) AS mean_probability, round(avg(is_win), 7) AS hit_rate, count(*) AS rows,
         round(avg(last_3f_time), 6) AS mean_sigma
  FROM entrants CROSS JOIN (SELECT quantile_cont(last_3f_time, 1 / 3::DOUBLE) AS a,
                                   quantile_cont(last_3f_time, 2 / 3::DOUBLE) AS b FROM entrants) GROUP BY 1"""))
def confidence_groups(spark, sf):
    df = entrants(spark, sf, [*KEY, "last_3f_time", "win_probability", "is_win"])
    out = metrics.by_confidence(df, "last_3f_time", "win_probability", "is_win")
    return out.select("confidence", "rows", F.round("mean_probability", 7).alias("mean_probability"),
                      F.round("hit_rate", 7).alias("hit_rate"), F.round("mean_sigma", 6).alias("mean_sigma"))


@query("fixed_threshold_backtest", "A35", with_entrants("""
  SELECT count(*) AS bets, sum(CASE WHEN b.horse_number = w.horse_number THEN 1 ELSE 0 END)::BIGINT AS hits,
         count(*) * 100 AS staked, sum(CASE WHEN b.horse_number = w.horse_number THEN w.win_odds * 100 ELSE 0 END) AS returned,
         round(sum(CASE WHEN b.horse_number = w.horse_number THEN 1 ELSE 0 END) * 100 / count(*), 6) AS hit_rate,
         round(sum(CASE WHEN b.horse_number = w.horse_number THEN w.win_odds * 100 ELSE 0 END) / (count(*) * 100) * 100, 6) AS roi
  FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(win_probability, 7) DESC, horse_number) AS r FROM entrants) b
  LEFT JOIN (SELECT * FROM entrants WHERE finish_position = 1) w ON b.race_id = w.race_id
  WHERE r = 1 AND round(b.win_probability, 7) >= 0.2"""))
def fixed_threshold_backtest(spark, sf):
    df = entrants(spark, sf, ["race_id", "horse_number", "win_probability", "finish_position", "win_odds"])
    p = df.select("race_id", "horse_number", F.round("win_probability", 7).alias("win_probability"))
    out = metrics.fixed_threshold_backtest(p, df.filter("finish_position = 1"), "race_id", "horse_number", "win_probability")
    return out.select("bets", "hits", "staked", "returned", F.round("hit_rate", 6).alias("hit_rate"), F.round("roi", 6).alias("roi"))


_DAILY = ("daily AS (SELECT CAST(ts AS DATE) AS day, event_type AS strategy, avg(value - 49) / 1000 AS r "
          "FROM events GROUP BY ALL)")


def _daily(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day"), F.col("event_type").alias("strategy")
                                              ).agg((F.avg(F.col("value") - 49) / 1000).alias("r"))


@query("equity_curve", "W20", f"""WITH {_DAILY}
  SELECT strategy, CAST(day AS STRING) AS day, round(c, 6) AS capital, round((c - max(c) OVER w) / max(c) OVER w, 6) AS drawdown
  FROM (SELECT *, 1000 * exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY day)) AS c FROM daily)
  WINDOW w AS (PARTITION BY strategy ORDER BY day)""")
def equity_curve(spark, sf):
    out = metrics.equity_curve(_daily(spark, sf), "day", "r", 1000.0, "strategy")
    return out.select("strategy", F.col("day").cast("string").alias("day"), F.round("capital", 6).alias("capital"),
                      F.round("drawdown", 6).alias("drawdown"))


@query("return_summary", "W20", f"""WITH {_DAILY}, total AS (SELECT day, avg(r) AS r FROM daily GROUP BY day),
    curve AS (SELECT *, 1000 * exp(sum(ln(1 + r)) OVER (ORDER BY day)) AS c FROM total)
  SELECT round(max_by(c, day) / 1000 - 1, 7) AS total_return, round(min(d), 7) AS max_drawdown,
         round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe
  FROM (SELECT *, (c - max(c) OVER (ORDER BY day)) / max(c) OVER (ORDER BY day) AS d FROM curve)""")
def return_summary(spark, sf):
    total = _daily(spark, sf).groupBy("day").agg(F.avg("r").alias("r"))
    out = metrics.return_summary(metrics.equity_curve(total, "day", "r", 1000.0), "day", "r", 1000.0)
    return out.select(F.round("total_return", 7).alias("total_return"), F.round("max_drawdown", 7).alias("max_drawdown"),
                      F.round("sharpe", 6).alias("sharpe"))


@query("period_change", "W21", """
  WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS m, avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS h
             FROM events GROUP BY 1)
  SELECT round(avg(m), 6) AS m, round(avg(dm), 6) AS m_change, round(avg(h), 6) AS h, round(avg(dh), 6) AS h_change
  FROM (SELECT *, m - lag(m) OVER (ORDER BY day) AS dm, h - lag(h) OVER (ORDER BY day) AS dh FROM d
        WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')""")
def period_change(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        F.avg("value").alias("m"), F.avg((F.col("event_type") == "purchase").cast("int")).alias("h"))
    out = metrics.mean_change(daily, "day", ["m", "h"], F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("monthly_return_pivot", "A37", """
  SELECT year(o_orderdate) AS year, """ + ", ".join(
    f"round(sum(o_totalprice) FILTER (month(o_orderdate) = {m}), 2) AS month_{m}" for m in range(1, 13))
    + " FROM orders GROUP BY 1")
def monthly_return_pivot(spark, sf):
    out = metrics.monthly_pivot(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select("year", *[F.round(f"month_{m}", 2).alias(f"month_{m}") for m in range(1, 13)])
