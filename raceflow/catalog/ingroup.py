"""Measures within a race, and rows picked per group."""

from pyspark.sql import functions as F

from raceflow import skew
from raceflow.bindings import KEY, TIMELINE, entrants, hot_races, table, with_entrants
from raceflow.functions.bands import running_style
from raceflow.operators import ingroup
from raceflow.registry import query

K = "race_id, horse_id, jockey_id, bracket_number"


def _rounded(df, *columns, digits=5):
    return df.select(*KEY, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in columns])


@query("race_z_score", "W6", with_entrants(f"""
  SELECT {K}, """ + ", ".join(
    f"round(({c} - avg({c}) OVER r) / (stddev_samp({c}) OVER r + 1e-6), 4) AS {c}_zscore"
    for c in ("horse_weight", "basis_weight", "win_odds")) + """
  FROM entrants WINDOW r AS (PARTITION BY race_id)"""))
def race_z_score(spark, sf):
    columns = ["horse_weight", "basis_weight", "win_odds"]
    out = ingroup.z_score(entrants(spark, sf, [*KEY, *columns]), "race_id", columns, hot_races(spark, sf))
    return _rounded(out, *[f"{c}_zscore" for c in columns], digits=4)


@query("race_deviation_score", "W7", with_entrants(f"""
  SELECT {K}, CASE WHEN stddev_samp(finish_time_seconds) OVER r > 0 THEN
           round(50 + 10 * (finish_time_seconds - avg(finish_time_seconds) OVER r)
                 / stddev_samp(finish_time_seconds) OVER r, 5) END AS time_deviation,
         round(50 + 10 * (horse_weight - avg(horse_weight) OVER r)
               / (stddev_samp(horse_weight) OVER r + 0.1), 5) AS horse_weight_deviation
  FROM entrants WINDOW r AS (PARTITION BY race_id)"""))
def race_deviation_score(spark, sf):
    hot = hot_races(spark, sf)
    df = entrants(spark, sf, [*KEY, "finish_time_seconds", "horse_weight"])

    def scored(rows, own):
        rows = ingroup.deviation_score(rows, "race_id", "finish_time_seconds", "time_deviation", hot=own)
        return ingroup.deviation_score(rows, "race_id", "horse_weight", "horse_weight_deviation", damped=True, hot=own)

    return _rounded(skew.by_part(df, ["race_id"], hot, scored), "time_deviation", "horse_weight_deviation")


@query("rank_within_race", "W8", with_entrants(f"""
  SELECT {K}, rank() OVER (PARTITION BY race_id ORDER BY last_3f_time) AS last3f_rank,
         CASE WHEN prize_money IS NOT NULL THEN
           rank() OVER (PARTITION BY race_id ORDER BY prize_money DESC NULLS LAST) END AS prize_rank
  FROM entrants"""))
def rank_within_race(spark, sf):
    hot = hot_races(spark, sf)
    df = entrants(spark, sf, [*KEY, "last_3f_time", "prize_money"])

    def ranked(rows, own):
        rows = skew.rank_within(rows, ["race_id"], "last_3f_time", "last3f_rank", hot=own)
        return skew.rank_within(rows, ["race_id"], "prize_money", "prize_rank", ascending=False, hot=own)

    return skew.by_part(df, ["race_id"], hot, ranked).drop("last_3f_time", "prize_money")


@query("gap_to_race_best", "W9", with_entrants(
    f"SELECT {K}, round(last_3f_time - min(last_3f_time) OVER (PARTITION BY race_id), 6)"
    " AS last3f_diff_from_best FROM entrants"))
def gap_to_race_best(spark, sf):
    df = entrants(spark, sf, [*KEY, "last_3f_time"])
    out = ingroup.gap_to_best(df, "race_id", "last_3f_time", "last3f_diff_from_best", hot_races(spark, sf))
    return _rounded(out, "last3f_diff_from_best", digits=6)


@query("gap_and_ratio_to_race_mean", "W10", with_entrants(f"""
  SELECT {K}, round(basis_weight - avg(basis_weight) OVER r, 5) AS weight_diff_from_avg,
         round(win_odds / avg(win_odds) OVER r, 5) AS relative_odds
  FROM entrants WINDOW r AS (PARTITION BY race_id)"""))
def gap_and_ratio_to_race_mean(spark, sf):
    hot = hot_races(spark, sf)
    df = entrants(spark, sf, [*KEY, "basis_weight", "win_odds"])
    df = ingroup.gap_and_ratio_to_mean(df, "race_id", "basis_weight", "weight_diff_from_avg", "_r1", hot)
    df = ingroup.gap_and_ratio_to_mean(df, "race_id", "win_odds", "_r2", "relative_odds", hot)
    return _rounded(df, "weight_diff_from_avg", "relative_odds")


@query("group_outlier_flag", "W14", with_entrants(f"""
  SELECT {K}, coalesce(abs(finish_time_seconds - avg(finish_time_seconds) OVER g)
               > 3 * stddev_samp(finish_time_seconds) OVER g, false) AS time_outlier_flag
  FROM (SELECT * REPLACE (CASE WHEN horse_id % 97 = 0 THEN finish_time_seconds * 9 ELSE finish_time_seconds END
        AS finish_time_seconds) FROM entrants)
  WINDOW g AS (PARTITION BY distance_m, track_surface)"""))
def group_outlier_flag(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_time_seconds", "distance_m", "track_surface"])
    # stretch some times so that the rule has something to flag
    t = F.col("finish_time_seconds")
    df = df.withColumn("finish_time_seconds", F.when(F.col("horse_id") % 97 == 0, t * 9).otherwise(t))
    out = ingroup.outlier_flag(df, ["distance_m", "track_surface"], "finish_time_seconds")
    return out.select(*KEY, "time_outlier_flag")


@query("keep_last_per_key", "W15", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""")
def keep_last_per_key(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ingroup.top_rows(df, ["l_orderkey", "l_linenumber"], [("l_partkey", False), ("l_suppkey", False)], 1)


@query("best_pick_per_race", "W16", with_entrants(f"""
  SELECT {K}, predicted_score FROM (SELECT *, row_number() OVER (PARTITION BY race_id
    ORDER BY predicted_score, horse_id, jockey_id, bracket_number) AS r FROM entrants) WHERE r = 1"""))
def best_pick_per_race(spark, sf):
    df = entrants(spark, sf, [*KEY, "predicted_score"])
    return ingroup.best_row(df, "race_id", "predicted_score", KEY[1:])


@query("relevance_label", "W17", with_entrants(f"""
  SELECT {K}, greatest(0, least(30, count(*) OVER (PARTITION BY race_id) - row_number() OVER (
    PARTITION BY race_id ORDER BY finish_time_seconds, horse_id, jockey_id, bracket_number))) AS relevance
  FROM entrants"""))
def relevance_label(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_time_seconds"])
    order = ["finish_time_seconds", *KEY[1:]]
    return ingroup.relevance(df, "race_id", order, hot=hot_races(spark, sf)).drop("finish_time_seconds")


@query("k_smallest_per_race", "W18", with_entrants(f"""
  SELECT {K}, finish_time_seconds FROM (SELECT *, row_number() OVER (PARTITION BY race_id
    ORDER BY finish_time_seconds, horse_id, jockey_id, bracket_number) AS r FROM entrants) WHERE r <= 3"""))
def k_smallest_per_race(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_time_seconds"])
    return ingroup.top_rows(df, ["race_id"], ["finish_time_seconds", *KEY[1:]], 3)


@query("sequence_position_in_group", "W19", with_entrants(f"""
  SELECT {K}, row_number() OVER (PARTITION BY horse_id, track_surface
    ORDER BY race_date, race_id, jockey_id, bracket_number) AS position FROM entrants"""))
def sequence_position_in_group(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date", "track_surface"])
    return skew.row_numbers(df, ["horse_id", "track_surface"], TIMELINE, "position").drop(
        "race_date", "track_surface")


@query("group_size", "W23", with_entrants(f"SELECT {K}, head_count FROM entrants"))
def group_size(spark, sf):
    return ingroup.group_size(entrants(spark, sf, KEY), "race_id", hot=hot_races(spark, sf))


@query("minimum_group_size", "P11", with_entrants(f"SELECT {K} FROM entrants WHERE head_count >= 5"))
def minimum_group_size(spark, sf):
    return ingroup.at_least(entrants(spark, sf, KEY), "race_id", 5, hot_races(spark, sf))


@query("group_composition_ratio", "A9", with_entrants("""
  SELECT race_id, round(avg(CASE WHEN passing_order_1 = 1 THEN 1.0 ELSE 0 END), 6) AS nige_ratio,
         round(avg(CASE WHEN passing_order_1 BETWEEN 2 AND 4 THEN 1.0 ELSE 0 END), 6) AS senko_ratio
  FROM entrants GROUP BY race_id"""))
def group_composition_ratio(spark, sf):
    df = entrants(spark, sf, [*KEY, "passing_order_1"])
    out = ingroup.share_by_value(df, "race_id", running_style(F.col("passing_order_1")),
                                 {"nige": "nige_ratio", "senko": "senko_ratio"}, hot_races(spark, sf))
    return out.groupBy("race_id").agg(*[F.round(F.first(c), 6).alias(c) for c in ("nige_ratio", "senko_ratio")])
