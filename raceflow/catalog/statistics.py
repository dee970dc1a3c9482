"""Entity, pair and pedigree statistics."""

from pyspark.sql import functions as F

from raceflow import skew
from raceflow.bindings import KEY, entrants, hot_jockeys, with_entrants
from raceflow.functions import bands
from raceflow.operators import stats
from raceflow.plans.features import DEFAULT_RECIPE
from raceflow.plans.learning import one_hot
from raceflow.registry import query
from raceflow.session import cut_lineage

K = "race_id, horse_id, jockey_id, bracket_number"
BAND = ("CASE WHEN distance_m <= 1400 THEN 'sprint' WHEN distance_m <= 1800 THEN 'mile' WHEN distance_m <= 2200 "
        "THEN 'intermediate' WHEN distance_m <= 3000 THEN 'long' WHEN distance_m <= 4000 THEN 'extreme_long' END")
ENTITY_RECIPES = DEFAULT_RECIPE["entity_stats"]
INTERACTION_RECIPES = DEFAULT_RECIPE["interaction_features"]


def _round(df, keep, digits=6):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keep])


def _banded(df):
    return df.withColumn("distance_category", bands.distance_right_closed(F.col("distance_m"))).drop("distance_m")


@query("entity_statistics", "A1", with_entrants(f"""
  SELECT {K}, round(jockey_win_rate, 6) AS jockey_win_rate, round(trainer_win_rate, 6) AS trainer_win_rate,
         round(sire_avg_prize, 6) AS sire_avg_prize, round(damsire_avg_prize, 5) AS damsire_avg_prize FROM entrants
  JOIN (SELECT jockey_id, avg(is_win) AS jockey_win_rate FROM entrants GROUP BY 1) USING (jockey_id)
  JOIN (SELECT trainer_id, avg(is_win) AS trainer_win_rate FROM entrants GROUP BY 1) USING (trainer_id)
  JOIN (SELECT sire_id, avg(prize_money) AS sire_avg_prize FROM entrants GROUP BY 1) USING (sire_id)
  JOIN (SELECT damsire_id, avg(prize_money) AS damsire_avg_prize FROM entrants GROUP BY 1) USING (damsire_id)"""))
def entity_statistics(spark, sf):
    df = entrants(spark, sf, [*KEY, "trainer_id", "sire_id", "damsire_id", "is_win", "prize_money"])
    out = stats.attach_all(df, stats.entity_statistics(df, ENTITY_RECIPES), {"jockey_id": hot_jockeys(spark, sf)})
    return out.select(*KEY, F.round("jockey_win_rate", 6).alias("jockey_win_rate"),
                      F.round("trainer_win_rate", 6).alias("trainer_win_rate"),
                      F.round("sire_avg_prize", 6).alias("sire_avg_prize"),
                      F.round("damsire_avg_prize", 5).alias("damsire_avg_prize"))


@query("entity_rate_before_day", "A1 J9", with_entrants(f"""
  SELECT {K}, round(avg(is_win) OVER (PARTITION BY jockey_id ORDER BY race_date
           RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS jockey_win_rate FROM entrants"""))
def entity_rate_before_day(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date", "is_win"])
    out = stats.entity_rate_before(df, "jockey_id", "race_date", "is_win", "jockey_win_rate")
    return out.select(*KEY, F.round("jockey_win_rate", 6).alias("jockey_win_rate"))


@query("interaction_statistics", "A2", with_entrants(f"""
  SELECT id, recipe, context, round(value, 6) AS value FROM (
    """ + " UNION ALL ".join(f"""SELECT CAST({r['id_column']} AS VARCHAR) AS id, '{r['id_column']}/{r['context_column']}' AS recipe, {c} AS context,
      CAST(avg({r['target']}) AS DOUBLE) AS value FROM entrants WHERE {c} IS NOT NULL GROUP BY ALL"""
      for r in INTERACTION_RECIPES for c in [BAND if r["context_column"] == "distance_category" else r["context_column"]]) + ")"))
def interaction_statistics(spark, sf):
    """All recipes in the long form: any number of contexts."""
    columns = ["sire_id", "trainer_id", "venue", "track_surface", "is_win", "distance_m", "finish_position"]
    df = _banded(entrants(spark, sf, [*KEY, *columns]))
    out = None
    for key in ("jockey_id", "sire_id", "trainer_id"):
        own = [r for r in INTERACTION_RECIPES if r["id_column"] == key]
        names = F.array(*[F.lit(f"{key}/{r['context_column']}") for r in own])
        rows = stats.interaction_rows(df, own).select(F.col(key).cast("string").alias("id"), F.get(names, F.col("recipe")).alias("recipe"),
                                                      "context", F.round("value", 6).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("interaction_columns", "A2", with_entrants("""
  SELECT jockey_id, """ + ", ".join(
    f"round(avg(is_win) FILTER (venue = 'NATION_{i}'), 6) AS jockey_NATION_{i}_win_rate" for i in range(25)) + ", " + ", ".join(
    f"round(avg(is_win) FILTER (({BAND}) = '{b}'), 6) AS jockey_{b}_win_rate"
    for b in ("extreme_long", "intermediate", "long", "mile", "sprint")) + ", " + ", ".join(
    f"round(avg(is_win) FILTER (track_surface = '{s}'), 6) AS jockey_{s}_win_rate" for s in "ANR")
    + " FROM entrants GROUP BY jockey_id"))
def interaction_columns(spark, sf):
    df = cut_lineage(_banded(entrants(spark, sf, [*KEY, "venue", "track_surface", "is_win", "distance_m"])))
    out = stats.interaction_statistics(df, [r for r in INTERACTION_RECIPES if r["id_column"] == "jockey_id"])
    return _round(out["jockey_id"], ["jockey_id"])


@query("statistics_before_each_row", "A1 A2 A6 J9", with_entrants(f"""
  SELECT {K}, round(avg(is_win) OVER (PARTITION BY jockey_id, venue {{0}}), 6) AS jockey_own_venue_win_rate,
         CASE WHEN count(*) OVER (PARTITION BY sire_id, damsire_id {{0}}) >= 5 THEN
           round(avg(finish_position) OVER (PARTITION BY sire_id, damsire_id {{0}}), 6) END AS nicks_avg_finish,
         CASE WHEN count(*) OVER (PARTITION BY sire_id, damsire_id {{0}}) >= 5 THEN
           round(stddev_samp(finish_position) OVER (PARTITION BY sire_id, damsire_id {{0}}), 5) END AS nicks_std_finish
  FROM entrants""".format("ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING")))
def statistics_before_each_row(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date", "venue", "sire_id", "damsire_id", "is_win", "finish_position"])
    out = stats.strictly_before(df, df, ["jockey_id", "venue"], "race_date", {"jockey_own_venue_win_rate": ("mean", "is_win")})
    out = stats.strictly_before(out, df, ["sire_id", "damsire_id"], "race_date", {
        "nicks_avg_finish": ("mean", "finish_position"), "nicks_std_finish": ("std", "finish_position")}, least=5)
    return out.select(*KEY, F.round("jockey_own_venue_win_rate", 6).alias("jockey_own_venue_win_rate"),
                      F.round("nicks_avg_finish", 6).alias("nicks_avg_finish"), F.round("nicks_std_finish", 5).alias("nicks_std_finish"))


@query("course_affinity", "A3", with_entrants(f"""
  SELECT horse_id, 'venue' AS course, venue AS value, round(avg(finish_position), 6) AS avg_finish,
         count(*) AS races, round(avg(morning_odds), 6) AS detail FROM entrants GROUP BY ALL
  UNION ALL SELECT horse_id, 'distance', {BAND}, round(avg(finish_position), 6), count(*),
         round(avg(finish_time_seconds), 6) FROM entrants GROUP BY ALL
  UNION ALL SELECT horse_id, 'surface', track_surface, round(avg(finish_position), 6), count(*),
         round(avg(last_3f_time), 6) FROM entrants GROUP BY ALL"""))
def course_affinity(spark, sf):
    df = _banded(entrants(spark, sf, [*KEY, "venue", "track_surface", "distance_m", "finish_position",
                                      "morning_odds", "finish_time_seconds", "last_3f_time"]))
    parts = []
    for course, column, detail in (("venue", "venue", "morning_odds"),
                                   ("distance", "distance_category", "finish_time_seconds"),
                                   ("surface", "track_surface", "last_3f_time")):
        t = stats.course_affinity(df, "horse_id", column, "c", {"detail": detail})
        parts.append(t.select("horse_id", F.lit(course).alias("course"), F.col(column).alias("value"),
                              F.round("c_avg_finish", 6).alias("avg_finish"), F.col("c_races").alias("races"),
                              F.round("detail", 6).alias("detail")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("pair_synergy", "A4", with_entrants("""
  SELECT jockey_id, trainer_id, round(avg(finish_position), 6) AS combo_avg_finish, count(*) AS combo_races,
         round(avg(popularity), 6) AS combo_avg_popularity, round(avg(morning_odds), 6) AS combo_avg_odds,
         round(avg(popularity) - avg(finish_position), 6) AS combo_overperform FROM entrants GROUP BY ALL"""))
def pair_synergy(spark, sf):
    df = entrants(spark, sf, [*KEY, "trainer_id", "finish_position", "popularity", "morning_odds"])
    out = stats.pair_synergy(df, "jockey_id", "trainer_id", odds="morning_odds")
    return _round(out, ["jockey_id", "trainer_id", "combo_races"])


@query("sire_statistics", "A5", with_entrants("""
  SELECT sire_id, round(avg(finish_position), 6) AS sire_avg_finish, round(stddev_samp(finish_position), 6) AS sire_std_finish,
         round(avg(distance_m), 6) AS sire_avg_distance FROM entrants GROUP BY ALL"""))
def sire_statistics(spark, sf):
    df = entrants(spark, sf, [*KEY, "sire_id", "finish_position", "distance_m"])
    return _round(stats.sire_statistics(df, "sire_id"), ["sire_id"])


@query("nicks", "A6", with_entrants("""
  SELECT sire_id, damsire_id, round(avg(finish_position), 6) AS nicks_avg_finish, count(*) AS nicks_count,
         round(stddev_samp(finish_position), 6) AS nicks_std_finish, round(avg(morning_odds), 6) AS nicks_avg_odds
  FROM entrants GROUP BY ALL HAVING count(*) >= 5"""))
def nicks(spark, sf):
    df = entrants(spark, sf, [*KEY, "sire_id", "damsire_id", "finish_position", "morning_odds"])
    out = stats.nicks(df, "sire_id", "damsire_id", odds="morning_odds")
    return _round(out, ["sire_id", "damsire_id", "nicks_count"])


@query("sire_course_means", "A7", with_entrants(f"""
  SELECT sire_id, venue, {BAND} AS distance_category, track_surface,
         round(avg(finish_position), 6) AS sire_course_avg_finish, round(avg(morning_odds), 6) AS sire_course_avg_odds
  FROM entrants GROUP BY ALL"""))
def sire_course_means(spark, sf):
    df = _banded(entrants(spark, sf, [*KEY, "sire_id", "venue", "distance_m", "track_surface", "finish_position", "morning_odds"]))
    keys = ["sire_id", "venue", "distance_category", "track_surface"]
    return _round(stats.sire_course(df, keys, odds="morning_odds"), keys)


@query("bracket_bias", "A8", with_entrants(f"""
  SELECT {K}, round(avg(finish_position) OVER (PARTITION BY venue, {BAND}, track_surface, bracket_number), 6)
    AS bracket_avg_finish FROM entrants"""))
def bracket_bias(spark, sf):
    df = _banded(entrants(spark, sf, [*KEY, "venue", "distance_m", "track_surface", "finish_position"]))
    keys = ["venue", "distance_category", "track_surface", "bracket_number"]
    out = skew.lookup(df, stats.mean_by(df, keys, "bracket_avg_finish"), keys)
    return out.select(*KEY, F.round("bracket_avg_finish", 6).alias("bracket_avg_finish"))


@query("mean_of_duplicates", "A10", with_entrants(
    "SELECT horse_id, round(avg(predicted_score), 6) AS mu FROM entrants GROUP BY horse_id"))
def mean_of_duplicates(spark, sf):
    out = stats.mean_by(entrants(spark, sf, [*KEY, "predicted_score"]), ["horse_id"], "mu", "predicted_score")
    return _round(out, ["horse_id"])


@query("sigma_training_table", "A11", with_entrants("""
  SELECT horse_id, round(avg((finish_position - mu) * (finish_position - mu)) + 1e-9, 6) AS sigma_target,
         min_by(age, (race_date, race_id, jockey_id, bracket_number)) AS age,
         round(avg(finish_position), 6) AS mean_finish_pos, round(coalesce(stddev_samp(finish_position), 0), 6) AS std_finish_pos,
         count(*) AS total_races
  FROM entrants JOIN (SELECT horse_id, avg(predicted_score) AS mu FROM entrants GROUP BY 1) USING (horse_id)
  GROUP BY horse_id"""))
def sigma_training_table(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date", "age", "finish_position", "predicted_score"])
    mu = df.select("horse_id", F.col("predicted_score").alias("mu"))
    out = stats.sigma_training(df, mu, "horse_id", ["race_date", "race_id", "jockey_id", "bracket_number"])
    return out.select("horse_id", F.round(F.col("sigma_target") + F.lit(1e-9), 6).alias("sigma_target"), "age",
                      F.round("mean_finish_pos", 6).alias("mean_finish_pos"),
                      F.round("std_finish_pos", 6).alias("std_finish_pos"), "total_races")


_NU = """SELECT race_id, min_by(distance_m, (horse_id, jockey_id, bracket_number)) AS distance_m,
         min_by(track_surface, (horse_id, jockey_id, bracket_number)) AS track_surface, max(horse_number) AS head_count,
         avg(win_odds) AS avg_win_odds, coalesce(stddev_samp(win_odds), 0) AS std_win_odds,
         coalesce(stddev_samp(finish_position), 0) AS nu_target FROM entrants GROUP BY race_id"""


def _profile(spark, sf):
    df = entrants(spark, sf, [*KEY, "distance_m", "track_surface", "horse_number", "win_odds", "finish_position"])
    return df, stats.group_profile(df, "race_id", KEY[1:], ["distance_m", "track_surface"])


@query("nu_training_table", "A12", with_entrants(f"""
  SELECT race_id, distance_m, head_count, round(avg_win_odds, 6) AS avg_win_odds, round(std_win_odds, 6) AS std_win_odds,
         round(nu_target, 6) AS nu_target, """ + ", ".join(
    f"CAST(track_surface = '{s}' AS INTEGER) AS track_surface_{s}" for s in "ANR") + f" FROM ({_NU})"))
def nu_training_table(spark, sf):
    df, profile = _profile(spark, sf)
    # same grouping key on both sides: the join needs no further shuffle
    out = one_hot(profile.join(stats.nu_target(df, "race_id"), "race_id"), "track_surface", "track_surface",
                  ["A", "N", "R"])
    out = out.drop("track_surface")
    return _round(out, [c for c in out.columns if c not in ("avg_win_odds", "std_win_odds", "nu_target")])


@query("race_level_features", "M14", with_entrants(f"""
  SELECT race_id, distance_m, track_surface, head_count, round(avg_win_odds, 6) AS avg_win_odds,
         round(std_win_odds, 6) AS std_win_odds FROM ({_NU})"""))
def race_level_features(spark, sf):
    _, profile = _profile(spark, sf)
    return _round(profile, ["race_id", "distance_m", "track_surface", "head_count"])


@query("numeric_means_per_race", "A13", with_entrants("""
  SELECT race_id, round(avg(age), 6) AS age, round(avg(basis_weight), 6) AS basis_weight,
         round(avg(win_odds), 6) AS win_odds, round(avg(prize_money), 6) AS prize_money FROM entrants GROUP BY race_id"""))
def numeric_means_per_race(spark, sf):
    df = entrants(spark, sf, ["race_id", "age", "basis_weight", "win_odds", "prize_money", "sex"])
    return _round(stats.numeric_means(df, "race_id"), ["race_id"])


@query("totals_and_top_earners", "A14", with_entrants("""
  SELECT horse_id, total, CAST(quantile_cont(total, 0.5) OVER () AS DOUBLE) AS median_total FROM (
    SELECT horse_id, sum(prize_money) AS total FROM entrants GROUP BY horse_id) ORDER BY total DESC, horse_id LIMIT 10"""))
def totals_and_top_earners(spark, sf):
    totals = cut_lineage(stats.totals_by(entrants(spark, sf, [*KEY, "prize_money"]), "horse_id", "prize_money", "total"))
    median, = skew.exact_quantiles(totals, "total", [0.5])
    return totals.orderBy(F.desc("total"), "horse_id").limit(10).withColumn("median_total", F.lit(median))
