"""Windows over an entity's own past."""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, TIMELINE, entrants, hot_horses, hot_races, table, with_entrants
from raceflow.operators import ingroup, timeline
from raceflow.registry import query

HORSE = "PARTITION BY horse_id ORDER BY race_date, race_id, jockey_id, bracket_number"
BEFORE = f"({HORSE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
K = "race_id, horse_id, jockey_id, bracket_number"
BASE = [*KEY, "race_date"]


def _history(spark, sf, columns, *specs):
    df = entrants(spark, sf, [*BASE, *columns])
    return timeline.with_history(df, ["horse_id"], TIMELINE, *specs, hot=hot_horses(spark, sf))


@query("race_feature_flagship", "W1 W2 W3 W5 W6 O1", with_entrants(f"""
  SELECT {K}, career_starts, career_wins, round(past_3, 6) AS past_3_finish_position_mean,
         days_since_last_race,
         round((career_wins - avg(career_wins) OVER (PARTITION BY race_id))
               / (stddev_samp(career_wins) OVER (PARTITION BY race_id) + 1e-6), 4) AS career_wins_zscore
  FROM (SELECT *, row_number() OVER ({HORSE}) - 1 AS career_starts,
          CAST(coalesce(sum(is_win) OVER {BEFORE}, 0) AS BIGINT) AS career_wins,
          avg(finish_position) OVER ({HORSE} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past_3,
          race_date - lag(race_date) OVER ({HORSE}) AS days_since_last_race FROM entrants)
  WHERE race_date >= DATE '1998-01-01' ORDER BY {K}"""))
def flagship(spark, sf):
    df = _history(spark, sf, ["finish_position", "is_win"],
                  timeline.start_count(), timeline.prior_sum("career_wins", F.col("is_win")),
                  timeline.rolling(["finish_position"], [3], ["mean"]),
                  timeline.days_since_previous("race_date"))
    df = df.filter(F.col("race_date") >= "1998-01-01")
    df = ingroup.z_score(df, "race_id", ["career_wins"], hot_races(spark, sf))
    return df.select(*KEY, "career_starts", "career_wins",
                     F.round("past_3_finish_position_mean", 6).alias("past_3_finish_position_mean"),
                     "days_since_last_race", F.round("career_wins_zscore", 4).alias("career_wins_zscore")
                     ).orderBy(*KEY)


@query("prior_start_count", "W1", with_entrants(
    f"SELECT {K}, row_number() OVER ({HORSE}) - 1 AS career_starts FROM entrants"))
def prior_start_count(spark, sf):
    return _history(spark, sf, [], timeline.start_count()).drop("race_date")


@query("prior_cumulative_sums", "W2", with_entrants(f"""
  SELECT {K}, CAST(coalesce(sum(is_win) OVER {BEFORE}, 0) AS BIGINT) AS career_wins,
         CAST(coalesce(sum(prize_money) OVER {BEFORE}, 0) AS DOUBLE) AS prize_total FROM entrants"""))
def prior_cumulative_sums(spark, sf):
    return _history(spark, sf, ["is_win", "prize_money"],
                    timeline.prior_sum("career_wins", F.col("is_win")),
                    timeline.prior_sum("prize_total", F.col("prize_money"))
                    ).drop("race_date", "is_win", "prize_money")


_WINDOWS, _AGGS = [1, 3, 5, 10], ["mean", "median", "std", "max"]
_SQL_AGG = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "max": "max({c})"}


def _rolling_sql(columns):
    return ", ".join(
        f"round(CAST({_SQL_AGG[a].format(c=c)} OVER ({HORSE} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) AS DOUBLE), 5)"
        f" AS past_{w}_{c}_{a}" for c in columns for w in _WINDOWS for a in _AGGS)


@query("prior_rolling_aggregates", "W3", with_entrants(
    f"SELECT {K}, {_rolling_sql(['finish_position', 'prize_money'])} FROM entrants"))
def prior_rolling_aggregates(spark, sf):
    columns = ["finish_position", "prize_money"]
    out = _history(spark, sf, columns, timeline.rolling(columns, _WINDOWS, _AGGS))
    names = [c for c in out.columns if c.startswith("past_")]
    return out.select(*KEY, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in names])


@query("previous_value_and_change_flag", "W4", with_entrants(f"""
  SELECT {K}, prev_jockey_id,
         CASE WHEN prev_jockey_id IS NOT NULL AND jockey_id <> prev_jockey_id THEN 1 ELSE 0 END AS is_jockey_id_changed,
         prev_prize_money,
         CASE WHEN prev_prize_money IS NOT NULL AND prize_money IS DISTINCT FROM prev_prize_money
              THEN 1 ELSE 0 END AS is_prize_money_changed
  FROM (SELECT *, lag(jockey_id) OVER ({HORSE}) AS prev_jockey_id,
               lag(prize_money) OVER ({HORSE}) AS prev_prize_money FROM entrants)"""))
def previous_value_and_change_flag(spark, sf):
    return _history(spark, sf, ["prize_money"], timeline.previous(["jockey_id", "prize_money"])
                    ).drop("race_date", "prize_money")


@query("days_since_previous_start", "W5", with_entrants(
    f"SELECT {K}, race_date - lag(race_date) OVER ({HORSE}) AS days_since_last_race FROM entrants"))
def days_since_previous_start(spark, sf):
    return _history(spark, sf, [], timeline.days_since_previous("race_date")).drop("race_date")


@query("expanding_win_rate", "W22", with_entrants(
    f"SELECT {K}, round(avg(is_win) OVER {BEFORE}, 6) AS career_win_rate FROM entrants"))
def expanding_win_rate(spark, sf):
    out = _history(spark, sf, ["is_win"], timeline.prior_rate("career_win_rate", F.col("is_win")))
    return out.select(*KEY, F.round("career_win_rate", 6).alias("career_win_rate"))


_DESC = "PARTITION BY horse_id ORDER BY race_date DESC, race_id DESC, jockey_id DESC, bracket_number DESC"


@query("recent_form_summary", "W11", with_entrants(f"""
  SELECT horse_id, """ + ", ".join(f"""
    round(avg(finish_position) FILTER (r <= {w}), 6) AS avg_finish_last{w},
    round(avg(CASE WHEN finish_position = 1 THEN 1 ELSE 0 END) FILTER (r <= {w}), 6) AS win_rate_last{w},
    round(avg(CASE WHEN finish_position <= 2 THEN 1 ELSE 0 END) FILTER (r <= {w}), 6) AS place_rate_last{w}"""
    for w in (3, 5, 10)) + f"""
  FROM (SELECT *, row_number() OVER ({_DESC}) AS r FROM entrants) GROUP BY horse_id"""))
def recent_form_summary(spark, sf):
    df = entrants(spark, sf, [*BASE, "finish_position"])
    out = timeline.recent_summary(df, "horse_id", TIMELINE, [3, 5, 10])
    return out.select("horse_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "horse_id"])


@query("improvement_rate", "W12", with_entrants("""
  SELECT horse_id, """ + ", ".join(f"""
    CASE WHEN max(n) >= 2 THEN round(
      (avg(finish_position) FILTER (r <= {w} AND r > least(n, {w}) - {w // 2})
       - avg(finish_position) FILTER (r <= {w // 2}))
      / avg(finish_position) FILTER (r <= {w} AND r > least(n, {w}) - {w // 2}), 6) END AS improvement_rate_{w}"""
    for w in (3, 5, 10)) + f"""
  FROM (SELECT *, row_number() OVER ({_DESC}) AS r, count(*) OVER (PARTITION BY horse_id) AS n FROM entrants)
  GROUP BY horse_id"""))
def improvement(spark, sf):
    df = entrants(spark, sf, [*BASE, "finish_position"])
    out = timeline.improvement_rate(df, "horse_id", TIMELINE, [3, 5, 10])
    return out.select("horse_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "horse_id"])


@query("form_state", "W13", with_entrants(f"""
  SELECT horse_id, round(d, 6) AS form_derivative,
         CASE WHEN d < -0.5 THEN 'improving' WHEN d > 0.5 THEN 'declining' ELSE 'stable' END AS form_state
  FROM (SELECT horse_id, avg(finish_position) FILTER (r <= 3)
               - avg(finish_position) FILTER (r BETWEEN 2 AND 4) AS d
        FROM (SELECT *, row_number() OVER ({_DESC}) AS r FROM entrants)
        GROUP BY horse_id HAVING count(*) >= 5)"""))
def form(spark, sf):
    df = entrants(spark, sf, [*BASE, "finish_position"])
    out = timeline.form_state(df, "horse_id", TIMELINE)
    return out.withColumn("form_derivative", F.round("form_derivative", 6))


@query("last_rows_per_entity", "O4", with_entrants(
    f"SELECT {K}, r AS recency FROM (SELECT *, row_number() OVER ({_DESC}) AS r FROM entrants) WHERE r <= 5"))
def last_rows_per_entity(spark, sf):
    df = entrants(spark, sf, BASE)
    return timeline.last_rows(df, ["horse_id"], TIMELINE, 5, "recency").drop("race_date")


@query("growth_curve", "A36", with_entrants(f"""
  SELECT horse_id, count(*) AS starts, round(regr_slope(finish_position, i), 6) AS growth_slope,
         round(sqrt(greatest(regr_syy(finish_position, i) * (1 - regr_r2(finish_position, i)), 0.0) / count(*)), 4)
           AS growth_stability
  FROM (SELECT *, row_number() OVER ({HORSE}) - 1 AS i FROM entrants)
  GROUP BY horse_id HAVING min(age) <= 3 AND count(*) >= 3"""))
def growth_curve(spark, sf):
    df = entrants(spark, sf, [*BASE, "finish_position", "age"])
    out = timeline.growth_curve(df, "horse_id", TIMELINE, hot=hot_horses(spark, sf))
    return out.select("horse_id", "starts", F.round("growth_slope", 6).alias("growth_slope"),
                      F.round("growth_stability", 4).alias("growth_stability"))


@query("point_in_time_history", "J9", with_entrants(f"""
  SELECT {K}, prior_starts, round(prior_wins / nullif(prior_starts, 0), 6) AS prior_win_rate
  FROM (SELECT *, count(*) OVER (PARTITION BY horse_id ORDER BY race_date
                RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS prior_starts,
          coalesce(sum(is_win) OVER (PARTITION BY horse_id ORDER BY race_date
                RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS prior_wins
        FROM entrants)"""))
def point_in_time_history(spark, sf):
    df = entrants(spark, sf, [*BASE, "is_win"])
    out = timeline.before_day(df, "horse_id", "race_date",
                              {"prior_starts": F.lit(1), "prior_wins": F.col("is_win")})
    return out.select(*KEY, "prior_starts",
                      F.round(F.try_divide("prior_wins", "prior_starts"), 6).alias("prior_win_rate"))


@query("as_of_profile", "J9", with_entrants("").rstrip() + f""", profile AS (
    SELECT l_partkey, CAST(l_shipdate AS DATE) AS seen, max(400 + l_suppkey % 120) AS weight FROM lineitem GROUP BY ALL)
  SELECT {K}, seen, weight FROM (
    SELECT e.*, CASE WHEN p.seen + 60 >= e.race_date THEN p.seen END AS seen, CASE WHEN p.seen + 60 >= e.race_date THEN p.weight END AS weight
    FROM entrants e ASOF LEFT JOIN profile p ON e.horse_id = p.l_partkey AND e.race_date > p.seen)""")
def as_of_profile(spark, sf):
    """The horse's newest weighing before the day of the race, if not over 60 days old."""
    seen = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("horse_id"), F.col("l_shipdate").cast("date").alias("seen"),
                                               (400 + F.col("l_suppkey") % 120).alias("weight"))
    return timeline.as_of(entrants(spark, sf, BASE), seen, ["horse_id"], "race_date", "seen", ["weight"],
                          tolerance=F.expr("INTERVAL 60 DAYS"), strict=True, hot=hot_horses(spark, sf)).select(*KEY, "seen", "weight")


@query("as_of_latest_price", "J9 S9", """
  WITH price AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
  SELECT e.event_id, CASE WHEN p.ts >= e.ts - INTERVAL 1 DAY THEN p.ts END AS seen, CASE WHEN p.ts >= e.ts - INTERVAL 1 DAY THEN p.value END AS price
  FROM events e ASOF LEFT JOIN price p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type <> 'view'""")
def as_of_latest_price(spark, sf):
    """For every event that is not a view, the user's latest viewed value up to it, of the last day."""
    events = table(spark, sf, "events")
    views = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("price"))
    asked = events.filter("event_type <> 'view'").select("event_id", "user_id", "ts")
    out = timeline.as_of(asked, views, ["user_id"], "ts", "seen", ["price"], tolerance=F.expr("INTERVAL 1 DAY"))
    return out.select("event_id", "seen", "price")
