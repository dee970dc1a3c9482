"""Model inputs, models and the full feature table."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from raceflow.bindings import KEY, TIMELINE, entrants, hot_horses, hot_jockeys, hot_races, with_entrants
from raceflow.operators import ingroup, profile
from raceflow.plans import features, learning, listwise
from raceflow.registry import query
from raceflow.session import cut_lineage

K = "race_id, horse_id, jockey_id, bracket_number"
# the estimate known before the race is the one feature that tells the time
FEATURES = ["win_odds", "basis_weight", "age", "distance_m", "prior_estimate"]
_SOURCE = {c: "predicted_time" if c == "prior_estimate" else c for c in FEATURES}


@query("one_hot_encoding", "M1", with_entrants(f"""
  SELECT {K}, """ + ", ".join(f"coalesce(CAST(s = '{v}' AS INTEGER), 0) AS track_{v}" for v in "ANR") + f""",
         CAST(s IS NULL AS INTEGER) AS track_nan FROM (SELECT *, CASE WHEN age <> 3 THEN track_surface END AS s FROM entrants)"""))
def one_hot_encoding(spark, sf):
    df = entrants(spark, sf, [*KEY, "track_surface", "age"])
    df = df.withColumn("track_surface", F.when(F.col("age") != 3, F.col("track_surface")))
    return learning.one_hot(df, "track_surface", "track", null_dummy=True).drop("track_surface", "age")


@query("one_hot_rows", "M1", with_entrants(f"""
  SELECT {K}, unnest(['horse_' || horse_id, CASE WHEN jockey_id % 7 = 0 THEN 'jockey_nan' ELSE 'jockey_' || jockey_id END]) AS feature, 1 AS value
  FROM entrants"""))
def one_hot_rows(spark, sf):
    """Dummies of every horse and jockey, far too many for columns, in the long form."""
    df = entrants(spark, sf, KEY).withColumns({"horse": F.col("horse_id"), "jockey": F.when(F.col("jockey_id") % 7 != 0, F.col("jockey_id"))})
    return learning.one_hot_rows(df, KEY, {"horse": "horse", "jockey": "jockey"}, null_dummy=True)


@query("imputation", "M2", with_entrants(f"""
  SELECT {K}, coalesce(prize_money, (SELECT quantile_cont(prize_money, 0.5) FROM entrants))::DOUBLE AS prize_money,
         coalesce(CASE WHEN age <> 3 THEN age END, (SELECT quantile_cont(age, 0.5) FROM entrants WHERE age <> 3))::DOUBLE AS age
  FROM entrants"""))
def imputation(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "age"]).withColumn("age", F.when(F.col("age") != 3, F.col("age")))
    return learning.impute(df, learning.fill_values(df, ["prize_money", "age"]))


@query("feature_vector", "M3", with_entrants(f"""
  SELECT {K}, round(coalesce(prize_money, (SELECT avg(prize_money) FROM entrants)), 6) AS f0, win_odds AS f1,
         CASE WHEN prize_money IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS f2, 0.0::DOUBLE AS f3 FROM entrants"""))
def feature_vector(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "win_odds"]).withColumn("win_odds", F.col("win_odds").cast("string"))
    a = vector_to_array(F.col("features"))
    out = learning.feature_vector(df, ["prize_money", "win_odds"])
    return out.select(*KEY, F.round(a[0], 6).alias("f0"), *[a[i].alias(f"f{i}") for i in (1, 2, 3)])


def _train(spark, sf, target, *more):
    df = entrants(spark, sf, [*KEY, *_SOURCE.values(), target, *more]).withColumnRenamed("predicted_time", "prior_estimate")
    return cut_lineage(learning.feature_vector(df, FEATURES))


SPLIT_DAY = "1997-01-01"
_SPLIT_SQL = f"""SELECT count(*) FILTER (race_date < DATE '{SPLIT_DAY}') AS trained_on, count(*) FILTER (race_date >= DATE '{SPLIT_DAY}') AS rows,
  true AS beats_baseline FROM entrants"""


def _split(df):
    return df.filter(F.col("race_date") < SPLIT_DAY), df.filter(F.col("race_date") >= SPLIT_DAY)


def _held_out(train, scored, target, prediction, margin=0.7):
    """Rows, and whether the error on later days is below ``margin`` of that of the jockey's earlier mean."""
    y = F.col(target).cast("double")
    overall = train.agg(F.avg(y)).scalar()
    means = train.groupBy("jockey_id").agg(F.avg(y).alias("_mean"))
    both = scored.join(means, "jockey_id", "left").withColumn("_base", F.coalesce("_mean", overall))

    def error(c):
        return F.sqrt(F.avg((y - F.col(c)) * (y - F.col(c))))

    out = both.agg(F.count(F.lit(1)).alias("rows"), (error(prediction) < margin * error("_base")).alias("beats_baseline"))
    return out.withColumn("trained_on", train.agg(F.count(F.lit(1))).scalar())


@query("time_regressor", "M4", with_entrants(_SPLIT_SQL))
def time_regressor(spark, sf):
    """Trained on the earlier days, judged on the later ones."""
    train, later = _split(_train(spark, sf, "finish_time_seconds", "race_date"))
    model = learning.time_regressor(train, "finish_time_seconds", trees=20)
    return _held_out(train, model.transform(later), "finish_time_seconds", "predicted_time")


@query("two_stage_rank_scorer", "M5 W17", with_entrants(_SPLIT_SQL))
def two_stage_rank_scorer(spark, sf):
    df = entrants(spark, sf, [*KEY, *_SOURCE.values(), "finish_time_seconds", "race_date"]).withColumnRenamed(
        "predicted_time", "prior_estimate")
    df = ingroup.relevance(df, "race_id", ["finish_time_seconds", *KEY[1:]], hot=hot_races(spark, sf))
    train, later = _split(cut_lineage(learning.feature_vector(df, FEATURES)))
    models = learning.two_stage(train, FEATURES, "finish_time_seconds", "relevance", trees=20, depth=4)
    return _held_out(train, learning.two_stage_predict(models, later), "finish_time_seconds", "predicted_time")


_SUMS = {"a": "e", "bx": "e * x", "bw": "e * w", "cxx": "e * x * x", "cxw": "e * x * w", "cww": "e * w * w"}


@query("listwise_rank_scorer", "M5", with_entrants(f"""
  , train AS (SELECT race_id, finish_position, win_odds, basis_weight FROM entrants WHERE race_date < DATE '{SPLIT_DAY}'),
    shape AS (SELECT avg(win_odds) AS mx, stddev_pop(win_odds) AS sx, avg(basis_weight) AS mw, stddev_pop(basis_weight) AS sw FROM train),
    z AS (SELECT race_id, finish_position, (win_odds - mx) / sx AS x, (basis_weight - mw) / sw AS w FROM train, shape),
    weights AS (WITH RECURSIVE newton(step, p, q) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
      SELECT step + 1, p + (hww * gx - hxw * gw) / (hxx * hww - hxw * hxw), q + (hxx * gw - hxw * gx) / (hxx * hww - hxw * hxw)
      FROM (SELECT max(step) AS step, max(p) AS p, max(q) AS q, sum(x - bx / a) AS gx, sum(w - bw / a) AS gw, sum(cxx / a - bx * bx / a / a) AS hxx,
                   sum(cxw / a - bx * bw / a / a) AS hxw, sum(cww / a - bw * bw / a / a) AS hww
            FROM (SELECT step, p, q, x, w, {", ".join(f"sum({x}) OVER behind AS {n}" for n, x in _SUMS.items())}
                  FROM (SELECT *, exp(p * x + q * w) AS e FROM z, newton WHERE step < 9)
                  WINDOW behind AS (PARTITION BY race_id ORDER BY finish_position DESC))) WHERE step IS NOT NULL)
      SELECT p, q FROM newton WHERE step = 9),
    scored AS (SELECT {K}, p * (win_odds - mx) / sx + q * (basis_weight - mw) / sw AS score FROM entrants, shape, weights)
  SELECT {K}, round(score, 4) AS score, round(exp(score) / sum(exp(score)) OVER (PARTITION BY race_id), 5) AS win_chance FROM scored"""))
def listwise_rank_scorer(spark, sf):
    """Fitted to whole finishing orders of the earlier days; score and winning chance of every entrant."""
    hot = hot_races(spark, sf)
    df = cut_lineage(entrants(spark, sf, [*KEY, "race_date", "finish_position", "win_odds", "basis_weight"]))
    train, _ = _split(df)
    model = listwise.fit(train, "race_id", ["finish_position"], ["win_odds", "basis_weight"], hot=hot)
    out = listwise.chances(df.withColumn("score", model.score()), "race_id", "score", hot=hot)
    return out.select(*KEY, F.round("score", 4).alias("score"), F.round("win_chance", 5).alias("win_chance"))


@query("ensemble_score", "M6", with_entrants(f"""
  SELECT {K}, round(0.5 * coalesce((avg(predicted_time) OVER r - predicted_time) / (stddev_samp(predicted_time) OVER r + 1e-6), 0)
         + 0.5 * coalesce((predicted_score - avg(predicted_score) OVER r) / (stddev_samp(predicted_score) OVER r + 1e-6), 0), 4) AS mu
  FROM entrants WINDOW r AS (PARTITION BY race_id)"""))
def ensemble_score(spark, sf):
    df = entrants(spark, sf, [*KEY, "predicted_time", "predicted_score"])
    out = learning.ensemble_score(df, "race_id", "predicted_time", "predicted_score", hot=hot_races(spark, sf))
    return out.select(*KEY, F.round("mu", 4).alias("mu"))


@query("expanding_date_folds", "M7", with_entrants("""
  SELECT fold, role, count(*) AS rows, count(DISTINCT race_date) AS days FROM (
    SELECT fold, race_date, CASE WHEN i < floor(n * (fold + 1) / 5) THEN 'train' WHEN i < floor(n * (fold + 2) / 5) THEN 'validate' END AS role
    FROM (SELECT race_date, row_number() OVER (ORDER BY race_date) - 1 AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT race_date FROM entrants)), (SELECT unnest([1, 2, 3]) AS fold))
  JOIN entrants USING (race_date) WHERE role IS NOT NULL GROUP BY ALL"""))
def expanding_date_folds(spark, sf):
    out = learning.with_folds(entrants(spark, sf, ["race_id", "race_date"]), "race_date", 3)
    per_day = out.groupBy("fold", "role", "race_date").agg(F.count(F.lit(1)).alias("_n"))
    return per_day.groupBy("fold", "role").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("days"))


@query("expanding_row_folds", "M7", with_entrants(f"""
  SELECT fold, {K}, CASE WHEN i < n - (6 - fold) * (n // 6) THEN 'train' ELSE 'validate' END AS role
  FROM (SELECT {K}, row_number() OVER (ORDER BY race_date, {K}) - 1 AS i, count(*) OVER () AS n FROM entrants),
       (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE i < n - (5 - fold) * (n // 6)"""))
def expanding_row_folds(spark, sf):
    out = learning.row_folds(entrants(spark, sf, [*KEY, "race_date"]), ["race_date", *KEY], 5)
    return out.select("fold", *KEY, "role")


@query("group_safe_holdout", "M8", with_entrants("""
  SELECT race_id, coalesce(sum(n) OVER (ORDER BY race_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         < floor((SELECT count(*) FROM entrants) * 0.8) AS is_train
  FROM (SELECT race_id, race_date, count(*) AS n FROM entrants GROUP BY ALL)"""))
def group_safe_holdout(spark, sf):
    out = learning.group_holdout(entrants(spark, sf, ["race_id", "race_date"]), "race_id", ["race_date", "race_id"])
    return out.select("race_id", "is_train")


@query("contiguous_folds", "M9", with_entrants(f"""
  SELECT {K}, ntile(5) OVER (ORDER BY race_date, race_id, horse_id, jockey_id, bracket_number) - 1 AS fold FROM entrants"""))
def contiguous_folds(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date"])
    return learning.contiguous_folds(df, ["race_date", *KEY], 5).drop("race_date")


@query("out_of_fold_stacking", "M9", with_entrants("SELECT count(*) AS trained_on, count(*) AS rows, true AS beats_baseline FROM entrants"))
def out_of_fold_stacking(spark, sf):
    """Every row is predicted by learners that have not seen it (five folds)."""
    df = _train(spark, sf, "finish_time_seconds", "race_date")
    df = learning.contiguous_folds(df, ["race_date", *KEY], 5)
    learners = {"linear": LinearRegression(labelCol="finish_time_seconds", regParam=0.1),
                "trees": learning.BoostedTrees(labelCol="finish_time_seconds", maxIter=10, maxDepth=4, seed=1)}
    stacked, _, _ = learning.stacked(df, "finish_time_seconds", learners)
    return _held_out(df, stacked, "finish_time_seconds", "stacked")


@query("uncertainty_target", "M10", with_entrants(f"""
  SELECT {K}, round(ln(abs(finish_time_seconds - predicted_time) + 1e-6), 6) AS log_residual,
         round(CASE WHEN finish_position - popularity > 0 THEN sqrt(finish_position - popularity)
               ELSE (SELECT sqrt(avg(finish_position)) FROM entrants) END, 6) AS sigma FROM entrants"""))
def uncertainty_target(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_time_seconds", "predicted_time", "finish_position", "popularity"])
    fallback = df.agg(F.sqrt(F.avg("finish_position"))).scalar()
    variance = (F.col("finish_position") - F.col("popularity")).cast("double")
    return df.select(*KEY, F.round(learning.log_residual(F.col("finish_time_seconds"), F.col("predicted_time")), 6).alias("log_residual"),
                     F.round(learning.sigma_from_variance(variance, fallback), 6).alias("sigma"))


@query("student_t_degrees_of_freedom", "M11", with_entrants("""
  , z AS (SELECT race_id, round((last_3f_time - 35.5) / 1.2, 6) AS z FROM entrants),
    grid AS (SELECT round(2.1 + i * 0.25, 6)::DOUBLE AS nu FROM (SELECT unnest(generate_series(0, 111)) AS i)),
    ll AS (SELECT race_id, nu, n, n * (lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi())) - (nu + 1) / 2 * s AS ll
           FROM (SELECT race_id, nu, count(*) AS n, sum(ln(1 + z * z / nu)) AS s FROM z, grid GROUP BY ALL))
  SELECT race_id, n, CASE WHEN n < 3 THEN 5.0 ELSE max_by(nu, (round(ll, 9), -nu)) END::DOUBLE AS nu FROM ll GROUP BY race_id, n"""))
def student_t_degrees_of_freedom(spark, sf):
    df = entrants(spark, sf, ["race_id", "last_3f_time"])
    df = df.withColumn("z", F.round((F.col("last_3f_time") - 35.5) / 1.2, 6))
    return learning.student_t_df(df, "race_id", "z", hot=hot_races(spark, sf))


@query("assembled_predictions", "M12", with_entrants(f"""
  SELECT {K}, horse_number, predicted_score AS mu, 1.0::DOUBLE AS sigma, round(greatest(coalesce(nu, 1.0), 0.0), 6) AS nu
  FROM entrants LEFT JOIN (SELECT race_id, stddev_samp(finish_position) - 1 AS nu FROM entrants GROUP BY 1) USING (race_id)"""))
def assembled_predictions(spark, sf):
    df = entrants(spark, sf, [*KEY, "horse_number", "predicted_score", "finish_position"])
    nu = df.groupBy("race_id").agg((F.stddev_samp("finish_position") - 1).alias("nu"))
    out = learning.assemble_predictions(df, "race_id", "predicted_score", None, nu, [*KEY, "horse_number"], hot_races(spark, sf))
    return out.withColumn("nu", F.round("nu", 6))


@query("importance_table", "M13", with_entrants(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({x}, finish_time_seconds)) = greatest({{0}}) AS leads, 10 AS features FROM entrants"
    for c, x in _SOURCE.items()).format(", ".join(f"abs(corr({x}, finish_time_seconds))" for x in _SOURCE.values()))))
def importance_table(spark, sf):
    """The feature with the largest gain is the one that goes with the target most; gains sum to 1."""
    df = _train(spark, sf, "finish_time_seconds")
    model = learning.time_regressor(df, "finish_time_seconds", trees=20)
    out = learning.importance_table(model, [*FEATURES, *[f"{c}_missing" for c in FEATURES]])
    whole = Window.partitionBy(F.lit(0))  # ten rows
    out = out.withColumns({"leads": (F.col("gain") == F.max("gain").over(whole)) & (F.abs(F.sum("gain").over(whole) - 1) < 1e-6),
                           "features": F.count(F.lit(1)).over(whole).cast("int")})
    return out.filter(F.col("feature").isin(FEATURES)).select("feature", "leads", "features")


# ---- the full table ----------------------------------------------------------

FROM_DAY = "2000-01-01"
_RAW = [*KEY, "race_date", "trainer_id", "venue", "sire_id", "damsire_id", "track_surface", "sex", "age", "distance_m",
        "finish_position", "finish_time_seconds", "last_3f_time", "win_odds", "morning_odds", "popularity", "basis_weight",
        "horse_weight", "prize_money", "is_win", "head_count", "horse_number", "passing_order_1", "passing_order_4"]


def _families(spark, sf, recipe=features.DEFAULT_RECIPE):
    entries = F.col("race_date") >= FROM_DAY
    hot = {"horse_id": hot_horses(spark, sf), "race_id": hot_races(spark, sf), "jockey_id": hot_jockeys(spark, sf)}
    return features.families(entries, entrants(spark, sf, _RAW), KEY, TIMELINE, recipe, hot=hot)


def feature_table(spark, sf, recipe=features.DEFAULT_RECIPE):
    return _families(spark, sf, recipe)[0]


_H = "PARTITION BY horse_id ORDER BY race_date, race_id, jockey_id, bracket_number"
_BAND = ("CASE WHEN distance_m <= 1400 THEN 'sprint' WHEN distance_m <= 1800 THEN 'mile' WHEN distance_m <= 2200 "
         "THEN 'intermediate' WHEN distance_m <= 3000 THEN 'long' WHEN distance_m <= 4000 THEN 'extreme_long' END")


@query("feature_table", "A1 A2 A3 A4 A6 A7 A8 W1 W2 W3 W4 W5 W6 W8 W10 W11 W22 M1 P3 P4 P7 F22 F23 D3 J1 J2 J9", with_entrants(f"""
  , b AS (SELECT *, {_BAND} AS band FROM entrants), past AS (SELECT * FROM b WHERE race_date < (SELECT min(race_date) FROM entrants
      WHERE race_date >= DATE '{FROM_DAY}')),
    h AS (SELECT *, row_number() OVER ({_H}) - 1 AS career_starts,
            coalesce(sum(prize_money) OVER ({_H} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prize_total,
            avg(is_win) OVER ({_H} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS career_win_rate,
            quantile_cont(last_3f_time, 0.5) OVER ({_H} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS past_5_last_3f_time_median,
            lag(trainer_id) OVER ({_H}) AS prev_trainer_id, race_date - lag(race_date) OVER ({_H}) AS days_since_last_race FROM b),
    e AS (SELECT * FROM h WHERE race_date >= DATE '{FROM_DAY}')
  SELECT {K}, career_starts, round(past_5_last_3f_time_median, 6) AS past_5_last_3f_time_median, days_since_last_race,
         CASE WHEN prev_trainer_id IS NOT NULL AND trainer_id IS DISTINCT FROM prev_trainer_id THEN 1 ELSE 0 END AS is_trainer_id_changed,
         round((prize_total - avg(prize_total) OVER r) / (stddev_samp(prize_total) OVER r + 1e-6), 4) AS prize_total_zscore,
         round((career_win_rate - avg(career_win_rate) OVER r) / (stddev_samp(career_win_rate) OVER r + 1e-6), 4) AS career_win_rate_zscore,
         CASE WHEN track_surface = 'N' THEN 1 ELSE 0 END AS "track_N", CASE WHEN bracket_number <= 3 THEN 1 ELSE 0 END AS bracket_is_inner,
         round(jockey_win_rate, 6) AS jockey_win_rate, round(jockey_mile_win_rate, 6) AS jockey_mile_win_rate,
         round(bracket_avg_finish, 6) AS bracket_avg_finish, combo_races, round(nicks_avg_finish, 6) AS nicks_avg_finish,
         dist_races, round(avg_finish_last5, 6) AS avg_finish_last5, month(race_date) AS race_month,
         rank() OVER (PARTITION BY race_id ORDER BY morning_odds) AS odds_rank,
         round(basis_weight - avg(basis_weight) OVER r, 6) AS weight_diff_from_avg
  FROM e
  LEFT JOIN (SELECT jockey_id, avg(is_win) AS jockey_win_rate, avg(is_win) FILTER (band = 'mile') AS jockey_mile_win_rate
             FROM past GROUP BY 1) USING (jockey_id)
  LEFT JOIN (SELECT venue, band, track_surface, bracket_number, avg(finish_position) AS bracket_avg_finish FROM past GROUP BY ALL)
    USING (venue, band, track_surface, bracket_number)
  LEFT JOIN (SELECT jockey_id, trainer_id, count(*) AS combo_races FROM past GROUP BY ALL) USING (jockey_id, trainer_id)
  LEFT JOIN (SELECT sire_id, damsire_id, avg(finish_position) AS nicks_avg_finish FROM past GROUP BY ALL HAVING count(*) >= 5)
    USING (sire_id, damsire_id)
  LEFT JOIN (SELECT horse_id, band, count(*) AS dist_races FROM past GROUP BY ALL) USING (horse_id, band)
  LEFT JOIN (SELECT horse_id, avg(finish_position) AS avg_finish_last5 FROM (SELECT *, row_number() OVER (PARTITION BY horse_id
               ORDER BY race_date DESC, race_id DESC, jockey_id DESC, bracket_number DESC) AS q FROM past) WHERE q <= 5 GROUP BY 1)
    USING (horse_id)
  WINDOW r AS (PARTITION BY race_id)"""))
def feature_table_checked(spark, sf):
    out = feature_table(spark, sf)
    six = ["past_5_last_3f_time_median", "jockey_win_rate", "jockey_mile_win_rate", "bracket_avg_finish", "nicks_avg_finish",
           "avg_finish_last5", "weight_diff_from_avg"]
    four = ["prize_total_zscore", "career_win_rate_zscore"]
    return out.select(*KEY, "career_starts", "days_since_last_race", "is_trainer_id_changed", "track_N", "bracket_is_inner",
                      "combo_races", "dist_races", "race_month", "odds_rank", *[F.round(c, 6).alias(c) for c in six],
                      *[F.round(c, 4).alias(c) for c in four])


_PAST = features.DEFAULT_RECIPE["past_performance"]
_SHAPE = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "std": "stddev_samp({c})", "max": "max({c})"}
_PAST_COLUMNS = {f"past_{n}_{c}_{agg}": f"{_SHAPE[agg].format(c=c)} OVER ({_H} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
                 for c in _PAST["columns"] if c in _RAW for n in _PAST["windows"] for agg in _PAST["aggregations"]}


@query("feature_table_past", "W2 W3", with_entrants(f"""
  , h AS (SELECT {K}, race_date, {", ".join(f"{x} AS {n}" for n, x in _PAST_COLUMNS.items())} FROM entrants)
  SELECT {K}, {", ".join(f"round({n}::DOUBLE, 5) AS {n}" for n in _PAST_COLUMNS)} FROM h WHERE race_date >= DATE '{FROM_DAY}'"""))
def feature_table_past(spark, sf):
    """Every rolling column of the table."""
    out = feature_table(spark, sf)
    return out.select(*KEY, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in _PAST_COLUMNS])


_VENUES = [f"NATION_{i}" for i in range(25)]
_BANDS = ["sprint", "mile", "intermediate", "long", "extreme_long"]


def _per_context(pattern, target, column, values):
    return {pattern.format(v): f"avg({target}) FILTER ({column} = '{v}')" for v in values}


# (keys, {column: aggregate over the past}, HAVING)
_TABLES = [
    (["jockey_id"], {"jockey_win_rate": "avg(is_win)", **_per_context("jockey_{}_win_rate", "is_win", "venue", _VENUES),
                     **_per_context("jockey_{}_win_rate", "is_win", "band", _BANDS),
                     **_per_context("jockey_{}_win_rate", "is_win", "track_surface", "ANR")}, ""),
    (["trainer_id"], {"trainer_win_rate": "avg(is_win)", **_per_context("trainer_{}_win_rate", "is_win", "venue", _VENUES)}, ""),
    (["sire_id"], {"sire_avg_prize": "avg(prize_money)", "sire_avg_finish": "avg(finish_position)",
                   "sire_std_finish": "stddev_samp(finish_position)", "sire_avg_distance": "avg(distance_m)",
                   **_per_context("sire_{}_avg_finish", "finish_position", "track_surface", "ANR"),
                   **_per_context("sire_{}_avg_finish", "finish_position", "band", _BANDS)}, ""),
    (["damsire_id"], {"damsire_avg_prize": "avg(prize_money)"}, ""),
    (["venue", "band", "track_surface", "bracket_number"], {"bracket_avg_finish": "avg(finish_position)"}, ""),
    (["jockey_id", "trainer_id"], {"combo_avg_finish": "avg(finish_position)", "combo_races": "count(*)",
                                   "combo_avg_popularity": "avg(popularity)",
                                   "combo_overperform": "avg(popularity) - avg(finish_position)", "combo_avg_odds": "avg(morning_odds)"}, ""),
    (["sire_id", "damsire_id"], {"nicks_avg_finish": "avg(finish_position)", "nicks_count": "count(*)",
                                 "nicks_std_finish": "stddev_samp(finish_position)", "nicks_avg_odds": "avg(morning_odds)"}, "HAVING count(*) >= 5"),
    (["sire_id", "venue", "band", "track_surface"], {"sire_course_avg_finish": "avg(finish_position)", "sire_course_avg_odds": "avg(morning_odds)"}, ""),
    (["horse_id", "venue"], {"venue_avg_finish": "avg(finish_position)", "venue_races": "count(*)"}, ""),
    (["horse_id", "band"], {"dist_avg_finish": "avg(finish_position)", "dist_races": "count(*)",
                            "dist_avg_time": "avg(finish_time_seconds)"}, ""),
    (["horse_id", "track_surface"], {"surface_avg_finish": "avg(finish_position)", "surface_races": "count(*)",
                                     "surface_avg_last3f": "avg(last_3f_time)"}, ""),
    (["horse_id"], {
        **{f"avg_finish_last{w}": f"avg(finish_position) FILTER (q <= {w})" for w in (3, 5, 10)},
        **{f"win_rate_last{w}": f"avg(CASE WHEN finish_position = 1 THEN 1 ELSE 0 END) FILTER (q <= {w})" for w in (3, 5, 10)},
        **{f"place_rate_last{w}": f"avg(CASE WHEN finish_position <= 2 THEN 1 ELSE 0 END) FILTER (q <= {w})" for w in (3, 5, 10)},
        **{f"improvement_rate_{w}": f"CASE WHEN max(n) >= 2 THEN (avg(finish_position) FILTER (q <= {w} AND q > least(n, {w}) - {w // 2})"
           f" - avg(finish_position) FILTER (q <= {w // 2})) / avg(finish_position) FILTER (q <= {w} AND q > least(n, {w}) - {w // 2}) END"
           for w in (3, 5, 10)},
        "nige_rate": "avg(CASE WHEN passing_order_1 = 1 THEN 1 ELSE 0 END)",
        "senko_rate": "avg(CASE WHEN passing_order_1 BETWEEN 2 AND 4 THEN 1 ELSE 0 END)"}, ""),
]
_STATISTICS = [c for _, columns, _ in _TABLES for c in columns]


@query("feature_table_statistics", "A1 A2 A3 A4 A5 A6 A7 A8 A9 W11 W12", with_entrants(f"""
  , b AS (SELECT *, {_BAND} AS band FROM entrants), past AS (SELECT *,
      row_number() OVER (PARTITION BY horse_id ORDER BY race_date DESC, race_id DESC, jockey_id DESC, bracket_number DESC) AS q,
      count(*) OVER (PARTITION BY horse_id) AS n
    FROM b WHERE race_date < (SELECT min(race_date) FROM entrants WHERE race_date >= DATE '{FROM_DAY}'))
  SELECT {K}, """ + ", ".join(f"round({c}::DOUBLE + 1e-9, 5) AS {c}" for c in _STATISTICS) + f""",
         round(avg(nige_rate) OVER r + 1e-9, 5) AS nige_ratio, round(avg(senko_rate) OVER r + 1e-9, 5) AS senko_ratio
  FROM (SELECT * FROM b WHERE race_date >= DATE '{FROM_DAY}') """ + " ".join(
    f"LEFT JOIN (SELECT {', '.join(keys)}, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM past GROUP BY {', '.join(keys)} {having})"
    f" USING ({', '.join(keys)})" for keys, columns, having in _TABLES) + " WINDOW r AS (PARTITION BY race_id)"))
def feature_table_statistics(spark, sf):
    """Every entity, pair, course and trend column of the table."""
    out = feature_table(spark, sf)
    return out.select(*KEY, *[F.round(F.col(c).cast("double") + F.lit(1e-9), 5).alias(c) for c in [*_STATISTICS, "nige_ratio", "senko_ratio"]])


@query("feature_table_has_no_results", "P4 Q4", with_entrants(f"""
  SELECT 0 AS forbidden, count(*) AS rows FROM entrants WHERE race_date >= DATE '{FROM_DAY}'"""))
def feature_table_has_no_results(spark, sf):
    """No result column of the race itself is in the table (checked by origin, see the tests)."""
    out = feature_table(spark, sf)
    checks = profile.feature_checks(out.drop(*KEY, "race_date"), features.RESULT_COLUMNS)
    return checks.agg(F.count_if("forbidden").cast("int").alias("forbidden")).withColumn("rows", out.agg(F.count(F.lit(1))).scalar())


@query("imputed_feature_table", "M2 P3", with_entrants(f"""
  , h AS (SELECT *, lag(finish_position) OVER ({_H}) AS last_finish, row_number() OVER ({_H}) - 1 AS starts FROM entrants),
    past AS (SELECT * FROM entrants WHERE race_date < (SELECT min(race_date) FROM entrants WHERE race_date >= DATE '{FROM_DAY}')),
    e AS (SELECT * FROM h LEFT JOIN (SELECT jockey_id, trainer_id, count(*) AS combo FROM past GROUP BY ALL) USING (jockey_id, trainer_id)
          WHERE race_date >= DATE '{FROM_DAY}')
  SELECT {K}, coalesce(last_finish, (SELECT quantile_cont(last_finish, 0.5) FROM e))::DOUBLE AS past_1_finish_position_mean,
         starts::DOUBLE AS career_starts, coalesce(combo, (SELECT quantile_cont(combo, 0.5) FROM e), 0)::DOUBLE AS combo_races FROM e"""))
def imputed_feature_table(spark, sf):
    """Every numeric column of the default recipe is filled; the medians of all are found family by family."""
    table, parts = _families(spark, sf)
    out = features.imputed(table, [*KEY, "race_date"], parts=parts())
    return out.select(*KEY, "past_1_finish_position_mean", "career_starts", "combo_races")
