"""Projections, filters, sorting and limits."""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, entrants, table, with_entrants
from raceflow.functions import bands
from raceflow.operators import selection
from raceflow.plans.features import DEFAULT_RECIPE
from raceflow.registry import query

K = "race_id, horse_id, jockey_id, bracket_number"
RESULT = ["finish_position", "finish_time_seconds", "is_win", "prize_money", "win_odds", "popularity"]


@query("tolerant_select", "P1", with_entrants(f"SELECT {K}, age, basis_weight FROM entrants"))
def tolerant_select(spark, sf):
    df = entrants(spark, sf, [*KEY, "age", "basis_weight", "win_odds"])
    return selection.tolerant_select(df, [*KEY, "age", "blinkers", "basis_weight"])


@query("reindex_fill", "P2", with_entrants(
    "SELECT race_id, horse_id, bracket_number, coalesce(prize_money, 0) AS prize_money, 0 AS track_bias FROM entrants"))
def reindex_fill(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "win_odds"])
    return selection.reindex_fill(df, ["race_id", "horse_id", "bracket_number", "prize_money", "track_bias"])


@query("select_feature_columns", "P3", with_entrants(
    "SELECT age, basis_weight, finish_position, horse_weight FROM entrants"))
def select_feature_columns(spark, sf):
    df = entrants(spark, sf, [*KEY, "horse_weight", "age", "sex", "win_odds", "popularity", "is_win",
                              "finish_position", "basis_weight", "venue"])
    return df.select(*selection.feature_columns(df, DEFAULT_RECIPE["exclude_patterns"]))


@query("drop_leaking_columns", "P4", with_entrants(f"SELECT {K}, age, morning_odds FROM entrants"))
def drop_leaking_columns(spark, sf):
    df = entrants(spark, sf, [*KEY, "age", "morning_odds", *RESULT])
    return selection.without_leakage(df, RESULT)


@query("drop_rows_with_nulls", "P5", with_entrants(
    f"SELECT {K}, prize_money FROM entrants WHERE prize_money IS NOT NULL"))
def drop_rows_with_nulls(spark, sf):
    return entrants(spark, sf, [*KEY, "prize_money"]).dropna(subset=["prize_money", "horse_id"])


@query("key_hygiene", "P6", """
  SELECT l_linenumber, l_suppkey, trim(raw) AS race_id FROM (
    SELECT l_linenumber, l_suppkey, CASE WHEN l_linenumber = 2 THEN 'nan' WHEN l_linenumber = 3 THEN NULL
           ELSE concat('  ', CAST(l_orderkey AS STRING), ' ') END AS raw FROM lineitem)
  WHERE raw IS NOT NULL AND trim(raw) <> 'nan'""")
def key_hygiene(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_linenumber", "l_suppkey", "CASE WHEN l_linenumber = 2 THEN 'nan' WHEN l_linenumber = 3 THEN NULL "
        "ELSE concat('  ', CAST(l_orderkey AS STRING), ' ') END AS race_id")
    return selection.clean_keys(df, ["race_id"])


@query("membership_flags", "P7", with_entrants(f"""
  SELECT {K}, CAST(bracket_number IN (1, 2, 3) AS INTEGER) AS bracket_is_inner,
         CAST(bracket_number IN (4, 5, 6) AS INTEGER) AS bracket_is_middle,
         CAST(bracket_number IN (7, 8) AS INTEGER) AS bracket_is_outer FROM entrants"""))
def membership_flags(spark, sf):
    df = entrants(spark, sf, KEY)
    return df.withColumns(bands.membership(F.col("bracket_number"), {
        "bracket_is_inner": [1, 2, 3], "bracket_is_middle": [4, 5, 6], "bracket_is_outer": [7, 8]}))


@query("regional_races", "P7 P8", """
  SELECT o_orderkey, o_custkey % 3 = 1 AS is_regional, CASE WHEN o_custkey % 3 = 1 THEN 0.3::DOUBLE END AS prize_scale_factor,
         CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 1 THEN '地方未勝利' ELSE '未勝利' END ELSE 'オープン' END AS race_class
  FROM orders""")
def regional_races(spark, sf):
    venue = F.element_at(F.array(F.lit("東京"), F.lit("園田"), F.lit(None).cast("string")), (F.col("o_custkey") % 3 + 1).cast("int"))
    named = F.when(F.col("o_custkey") % 2 == 0, "未勝利").otherwise("オープン")
    df = table(spark, sf, "orders").select("o_orderkey", venue.alias("venue"), named.alias("race_class"))
    return df.withColumns(bands.regional(F.col("venue"), F.col("race_class"))).drop("venue")


@query("conditional_update", "P8", with_entrants(f"""
  SELECT {K}, CASE WHEN finish_position <= head_count - 1 THEN finish_position END AS finish_position,
         CASE WHEN venue IN ('NATION_3', 'NATION_7') THEN 0.3::DOUBLE END AS prize_scale_factor FROM entrants"""))
def conditional_update(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_position", "head_count", "venue"])
    out = selection.set_where(df, {
        "finish_position": [(F.col("finish_position") > F.col("head_count") - 1, F.lit(None))],
        "prize_scale_factor": [(F.col("venue").isin("NATION_3", "NATION_7"), F.lit(0.3))]})
    return out.drop("head_count", "venue")


@query("value_filter", "P9", with_entrants(f"""
  SELECT {K} FROM entrants WHERE round(win_probability * win_odds, 9) >= 1.05 AND win_probability >= 0.01 AND win_odds >= 1.0"""))
def value_filter(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability", "win_odds"])
    df = df.withColumn("win_probability", F.round(F.col("win_probability") * F.col("win_odds"), 9) / F.col("win_odds"))
    return selection.value_bets(df, "win_probability", "win_odds", 1.05, 0.01).select(*KEY)


@query("prefix_and_year_filter", "P10", """
  SELECT o_orderkey, o_custkey FROM orders WHERE year(o_orderdate) = 1998 AND o_orderpriority LIKE '1%'""")
def prefix_and_year_filter(spark, sf):
    # a date range instead of year() so that the filter reaches the scan
    day = F.col("o_orderdate")
    orders = table(spark, sf, "orders")
    return orders.filter((day >= F.lit("1998-01-01").cast("timestamp_ntz")) & (day < F.lit("1999-01-01").cast("timestamp_ntz"))
                         & F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey")


@query("rename_and_template_names", "P12", with_entrants(
    f"SELECT {K}, age AS horse_age, CASE WHEN venue = 'NATION_3' THEN 1 ELSE 0 END AS at_NATION_3_flag FROM entrants"))
def rename_and_template_names(spark, sf):
    df = selection.relabel(entrants(spark, sf, [*KEY, "age", "venue"]), {"age": "horse_age", "absent": "x"})
    flag = selection.template_name("at_{context}_flag", "NATION 3")
    return df.withColumn(flag, (F.col("venue") == "NATION_3").cast("int")).drop("venue")


@query("trailing_window_filter", "P13", """
  SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-06-30' - 180 AND DATE '2000-06-30'""")
def trailing_window_filter(spark, sf):
    orders = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return selection.trailing_months(orders, "day", F.lit("2000-06-30").cast("date"), 6).select("o_orderkey")


@query("select_columns_by_family", "P14", with_entrants(
    "SELECT race_id, horse_id, jockey_id, basis_weight, horse_weight FROM entrants"))
def select_columns_by_family(spark, sf):
    df = entrants(spark, sf, [*KEY, "basis_weight", "horse_weight", "age"])
    return df.select(*selection.columns_like(df, prefixes=["race_"], suffixes=["_id", "_weight"]))


@query("sort_by_entity_and_time", "O1", with_entrants(f"""
  SELECT {K}, CAST(race_date AS STRING) AS race_date FROM entrants
  ORDER BY horse_id, race_date, race_id, jockey_id, bracket_number"""))
def sort_by_entity_and_time(spark, sf):
    df = entrants(spark, sf, [*KEY, "race_date"])
    return df.orderBy("horse_id", "race_date", "race_id", "jockey_id", "bracket_number").select(
        *KEY, F.col("race_date").cast("string").alias("race_date"))


@query("global_top_n", "O2", with_entrants(
    f"SELECT {K}, prize_money FROM entrants ORDER BY prize_money DESC NULLS LAST, {K} LIMIT 20"))
def global_top_n(spark, sf):
    return entrants(spark, sf, [*KEY, "prize_money"]).orderBy(F.desc_nulls_last("prize_money"), *KEY).limit(20)


@query("high_confidence_list", "O5", with_entrants(f"""
  SELECT {K}, round(win_probability, 6) AS win_probability FROM entrants WHERE round(win_probability, 9) > 0.2
  ORDER BY win_probability DESC, {K}"""))
def high_confidence_list(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability"])
    return (df.filter(F.round("win_probability", 9) > 0.2).orderBy(F.desc("win_probability"), *KEY)
            .withColumn("win_probability", F.round("win_probability", 6)))
