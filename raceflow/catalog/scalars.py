"""Cleaning rules and row-level measures.

The texts are spelled from the given columns by expressions that read the same
in Spark and in the oracle.
"""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, LOG_SQL, entrants, log_lines, table, with_entrants
from raceflow.functions import bands, text
from raceflow.registry import query

_K = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
K = "race_id, horse_id, jockey_id, bracket_number"
_INT = "CAST({} AS STRING)"
PART, SUPP, LINE = (_INT.format(c) for c in ("l_partkey", "l_suppkey", "l_linenumber"))


def text_rule(name, covers, source, columns, sql, table_name="lineitem", keys=_K):
    """Register ``columns(text)`` over ``source`` spelled per row of a table."""
    @query(name, covers, f"SELECT {keys}, {sql} FROM (SELECT {keys}, {source} AS t FROM {table_name})")
    def run(spark, sf):
        df = table(spark, sf, table_name).selectExpr(*keys.split(", "), f"{source} AS t")
        return df.select(*keys.split(", "), *[c.alias(n) for n, c in columns(F.col("t")).items()])
    return run


text_rule("text_int_or_null", "F1",
    f"CASE l_linenumber % 6 WHEN 0 THEN concat({PART}, '頭') WHEN 1 THEN '---' WHEN 2 THEN concat('-', {SUPP}) "
    f"WHEN 3 THEN concat({SUPP}, '.5') WHEN 4 THEN '0' ELSE ' ' END",
    lambda t: {"n": text.int_or_null(t)},
    "CASE WHEN t NOT IN ('---', '---.-', '') THEN "
    "nullif(TRY_CAST(regexp_replace(t, '[^0-9]', '', 'g') AS INTEGER), 0) END AS n")

text_rule("text_float_or_null", "F2",
    f"CASE l_linenumber % 6 WHEN 0 THEN concat({PART}, '.5kg') WHEN 1 THEN '---.-' WHEN 2 THEN concat('-', {SUPP}) "
    f"WHEN 3 THEN concat({SUPP}, '.2.3') WHEN 4 THEN '0' ELSE '.' END",
    lambda t: {"x": text.float_or_null(t)},
    "CASE WHEN t NOT IN ('---', '---.-', '') THEN "
    "nullif(TRY_CAST(regexp_replace(t, '[^0-9.]', '', 'g') AS DOUBLE), 0) END AS x")

text_rule("text_sex_and_age", "F3",
    f"CASE WHEN l_linenumber % 6 = 0 THEN '' ELSE concat(CASE l_linestatus WHEN 'O' THEN '牡' ELSE '牝' END, {LINE}) END",
    lambda t: dict(zip(("sex", "age"), text.sex_and_age(t))),
    "nullif(substr(t, 1, 1), '') AS sex, TRY_CAST(nullif(substr(t, 2), '') AS INTEGER) AS age")

text_rule("text_time_to_seconds", "F4",
    f"CASE WHEN l_partkey % 7 = 0 THEN '---' WHEN l_partkey % 3 = 0 THEN concat({SUPP}, '.', {LINE}) "
    f"ELSE concat({LINE}, ':', lpad(CAST(l_suppkey % 60 AS STRING), 2, '0'), '.', CAST(l_partkey % 30 AS STRING), 'x') END",
    lambda t: {"seconds": F.round(text.time_to_seconds(t), 4)},
    r"""round(CASE WHEN regexp_matches(t, '^\d+:\d+\.\d+') THEN
      CAST(regexp_extract(t, '^(\d+):(\d+)\.(\d+)', 1) AS BIGINT) * 60
      + CAST(regexp_extract(t, '^(\d+):(\d+)\.(\d+)', 2) AS BIGINT)
      + CAST(regexp_extract(t, '^(\d+):(\d+)\.(\d+)', 3) AS DOUBLE) / 10
    WHEN regexp_matches(t, '^\d+\.\d+') THEN CAST(regexp_extract(t, '^(\d+)\.(\d+)', 1) AS BIGINT)
      + CAST(regexp_extract(t, '^(\d+)\.(\d+)', 2) AS DOUBLE) / 10 END, 4) AS seconds""")

text_rule("text_margin_to_seconds", "F5",
    "CASE l_partkey % 10 WHEN 0 THEN 'ハナ' WHEN 1 THEN 'アタマ' WHEN 2 THEN 'クビ' WHEN 3 THEN '大差' WHEN 4 THEN '同着' "
    f"WHEN 5 THEN concat({LINE}, '.1/2') WHEN 6 THEN concat({LINE}, '/4') WHEN 7 THEN {SUPP} "
    f"WHEN 8 THEN concat({LINE}, '/0') ELSE '---' END",
    lambda t: {"seconds": text.margin_to_seconds(t)},
    r"""CASE t WHEN 'ハナ' THEN 0.02 WHEN 'アタマ' THEN 0.04 WHEN 'クビ' THEN 0.05 WHEN '大差' THEN 5.0 WHEN '同着' THEN 0.0
      ELSE CAST(round(0.2 * CASE
        WHEN regexp_matches(t, '^\d+\.\d+/\d+$') THEN CAST(split_part(t, '.', 1) AS DOUBLE)
          + CAST(split_part(split_part(t, '.', 2), '/', 1) AS DOUBLE) / CAST(split_part(t, '/', 2) AS DOUBLE)
        WHEN t LIKE '%/0' THEN NULL
        WHEN regexp_matches(t, '^\d+/\d+$') THEN CAST(split_part(t, '/', 1) AS DOUBLE) / CAST(split_part(t, '/', 2) AS DOUBLE)
        ELSE TRY_CAST(t AS DOUBLE) END, 3) AS DOUBLE) END::DOUBLE AS seconds""")

text_rule("text_weight_and_change", "F6",
    "CASE l_linenumber % 4 WHEN 0 THEN '---' WHEN 1 THEN CAST(400 + l_suppkey % 120 AS STRING) "
    "WHEN 2 THEN concat(CAST(400 + l_suppkey % 120 AS STRING), '(+', CAST(l_partkey % 30 AS STRING), ')') "
    "ELSE concat(CAST(400 + l_suppkey % 120 AS STRING), '(-', CAST(l_partkey % 30 AS STRING), ')') END",
    lambda t: dict(zip(("weight", "change"), text.weight_and_change(t))),
    r"TRY_CAST(regexp_extract(t, '^(\d+)', 1) AS INTEGER) AS weight, "
    r"TRY_CAST(replace(regexp_extract(t, '^\d+\(([+-]?\d+)\)', 1), '+', '') AS INTEGER) AS change")

text_rule("text_prize", "F7",
    "CASE WHEN l_linenumber % 5 = 0 THEN '---.-' WHEN l_linenumber % 5 = 1 THEN 'n/a' "
    "ELSE concat(CAST(1 + l_partkey % 9 AS STRING), ',', lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0'), '.', "
    "CAST(l_partkey % 10 AS STRING)) END",
    lambda t: {"prize": text.prize(t)},
    "CAST(round_even(TRY_CAST(replace(t, ',', '') AS DOUBLE), 0) AS BIGINT) AS prize")

text_rule("text_normalise_name", "F8",
    "CASE l_linenumber % 4 WHEN 0 THEN ' ' WHEN 1 THEN '---.-' WHEN 2 THEN '編集' "
    f"ELSE concat('  Owner ', {SUPP}, ' ') END",
    lambda t: {"name": text.name(t)},
    "CASE WHEN trim(t) NOT IN ('', '---', '---.-', '編集') THEN trim(t) END AS name")

text_rule("text_plain_odds", "F9",
    f"CASE l_linenumber % 4 WHEN 0 THEN '---' WHEN 1 THEN concat('1,', lpad({LINE}, 3, '0'), '.5') "
    f"WHEN 2 THEN 'x' ELSE concat('-', {SUPP}, '.2') END",
    lambda t: {"odds": text.plain_odds(t)},
    "TRY_CAST(replace(t, ',', '') AS DOUBLE) AS odds")

text_rule("id_from_link", "F10",
    f"concat('https://db.example/', CASE l_linenumber % 3 WHEN 0 THEN 'horse/' WHEN 1 THEN 'jockey/result/recent/' "
    f"ELSE 'trainer/' END, lpad({SUPP}, 5, '0'), '/')",
    lambda t: {k: text.id_from_link(t, k) for k in ("horse", "jockey", "trainer")},
    ", ".join(rf"nullif(regexp_extract(t, '/{k}/(?:result/recent/)?(\w+)', 1), '') AS {k}"
              for k in ("horse", "jockey", "trainer")))

text_rule("id_from_file_name", "F11",
    f"CASE l_linenumber % 3 WHEN 0 THEN concat('race_', lpad({PART}, 12, '2'), '.bin') "
    f"WHEN 1 THEN concat('horse_', lpad({PART}, 10, 'a'), '.bin') ELSE concat(lpad({PART}, 10, '3'), '_x') END",
    lambda t: {"race": text.race_id_from_file(t), "horse": text.horse_id_from_file(t)},
    r"nullif(regexp_extract(t, '(\d{12})', 1), '') AS race, coalesce(nullif(regexp_extract(t, "
    r"'(?:horse|ped)_([a-zA-Z0-9]{10})', 1), ''), nullif(regexp_extract(t, '^(\d{10})', 1), '')) AS horse")

text_rule("normalise_ancestor_id", "F12",
    f"CASE l_linenumber % 5 WHEN 0 THEN '000' WHEN 1 THEN '0000' WHEN 2 THEN concat('000a', lpad({PART}, 6, '0')) "
    f"WHEN 3 THEN concat({PART}, '-', {SUPP}) ELSE lpad({PART}, 11, '9') END",
    lambda t: {"ancestor_id": text.ancestor_id(t)},
    "CASE WHEN length(c) BETWEEN 4 AND 10 AND NOT regexp_matches(c, '^0+$') THEN c END AS ancestor_id"
    .replace("c)", "regexp_replace(t, '[^a-zA-Z0-9]', '', 'g'))").replace("(c,", "(regexp_replace(t, '[^a-zA-Z0-9]', '', 'g'),")
    .replace("THEN c ", "THEN regexp_replace(t, '[^a-zA-Z0-9]', '', 'g') "))

_Y, _M, _D = ("CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)")
text_rule("parse_dates", "F13",
    f"CASE o_orderkey % 4 WHEN 0 THEN concat({_Y}, '年', {_M}, '月', {_D}, '日') WHEN 1 THEN concat({_Y}, '/', {_M}, '/', {_D}) "
    f"WHEN 2 THEN concat({_Y}, '-', {_M}, '-', {_D}) ELSE concat({_Y}, '年', CAST(10 + o_custkey % 5 AS STRING), '月31日') END",
    lambda t: {"day": text.iso_date(t).cast("string"),
               "same_day": text.day_in_year(F.substring(t, 6, 20), F.substring(t, 1, 4)).cast("string")},
    r"""CAST(TRY_CAST(regexp_replace(t, '^(\d+)[年/-](\d+)[月/-](\d+)日?$', '\1-\2-\3') AS DATE) AS STRING) AS day,
      CASE WHEN t NOT LIKE '%-%' THEN CAST(TRY_CAST(regexp_replace(t, '^(\d+)[年/-](\d+)[月/-](\d+)日?$', '\1-\2-\3')
        AS DATE) AS STRING) END AS same_day""",
    "orders", "o_orderkey")

text_rule("full_width_to_half_width", "F14",
    f"translate(concat({_Y}, '/', {_M}, '/', {_D}, ' ', o_orderpriority), '0123456789/- ', '０１２３４５６７８９／－　')",
    lambda t: {"plain": text.to_half_width(t), "day": text.iso_date(text.to_half_width(t)).cast("string")},
    "translate(t, '０１２３４５６７８９／－　', '0123456789/- ') AS plain, CAST(CAST(split_part(translate(t, "
    "'０１２３４５６７８９／－　', '0123456789/- '), ' ', 1) AS DATE) AS STRING) AS day",
    "orders", "o_orderkey")

# months and days as single signs; the oracle spells them out
_SIGN_MONTHS = "".join(chr(0x32C0 + i) for i in range(12))
_SIGN_DAYS = "".join(chr(0x33E0 + i) for i in range(31))
text_rule("compatibility_dates", "F14 F13",
    f"concat(translate({_Y}, '0123456789', '０１２３４５６７８９'), '年', substring('{_SIGN_MONTHS}', CAST(month(o_orderdate) AS INT), 1), "
    f"substring('{_SIGN_DAYS}', CAST(day(o_orderdate) AS INT), 1))",
    lambda t: {"plain": text.compatibility_form(t), "day": text.iso_date(text.compatibility_form(t)).cast("string")},
    f"concat({_Y}, '年', {_M}, '月', {_D}, '日') AS plain, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day",
    "orders", "o_orderkey, o_orderdate")

text_rule("distance_surface_condition", "F15",
    "CASE p_partkey % 4 WHEN 0 THEN concat('芝', CAST(1000 + 60 * p_size AS STRING)) "
    "WHEN 1 THEN concat('ダ', CAST(1000 + 60 * p_size AS STRING), '稍重') "
    "WHEN 2 THEN CAST(1000 + 60 * p_size AS STRING) ELSE concat('芝右 外', CAST(1000 + 60 * p_size AS STRING), 'm') END",
    lambda t: dict(zip(("distance_m", "surface", "condition", "course_surface", "course_m"),
                       (*text.distance_surface_condition(t), *text.course(t)))),
    r"""CASE WHEN p_partkey % 4 <> 3 THEN CAST(regexp_extract(t, '(\d+)', 1) AS INTEGER) END AS distance_m,
      CASE p_partkey % 4 WHEN 0 THEN '芝' WHEN 1 THEN 'ダート' END AS surface,
      CASE p_partkey % 4 WHEN 1 THEN '稍重' END AS condition,
      CASE p_partkey % 4 WHEN 3 THEN '芝' END AS course_surface,
      CASE p_partkey % 4 WHEN 3 THEN CAST(regexp_extract(t, '(\d+)m', 1) AS INTEGER) END AS course_m""",
    "part", "p_partkey")

text_rule("meeting_split", "F16",
    f"CASE WHEN l_linenumber % 4 = 0 THEN '中山' ELSE concat({LINE}, '回中山', CAST(1 + l_suppkey % 12 AS STRING), '日目') END",
    lambda t: dict(zip(("round_of_year", "venue", "day_of_meeting"), text.meeting(t))),
    r"""TRY_CAST(regexp_extract(t, '(\d+)回(\S+?)(\d+)日目', 1) AS INTEGER) AS round_of_year,
      nullif(regexp_extract(t, '(\d+)回(\S+?)(\d+)日目', 2), '') AS venue,
      TRY_CAST(regexp_extract(t, '(\d+)回(\S+?)(\d+)日目', 3) AS INTEGER) AS day_of_meeting""")

text_rule("race_class_and_age_limit", "F17",
    "concat(CASE p_partkey % 5 WHEN 0 THEN '2歳' WHEN 1 THEN '3歳' WHEN 2 THEN '3歳以上' WHEN 3 THEN '4歳以上' ELSE '' END, "
    "CASE p_size % 8 WHEN 0 THEN 'GI' WHEN 1 THEN 'GII' WHEN 2 THEN 'GIII' WHEN 3 THEN 'オープン' WHEN 4 THEN '1600万' "
    "WHEN 5 THEN '未勝利' WHEN 6 THEN '新馬' ELSE '特別' END)",
    lambda t: {"race_class": text.race_class(t), "age_limit": text.age_limit(t)},
    """CASE WHEN t LIKE '%GIII%' THEN 'G3' WHEN t LIKE '%GII%' THEN 'G2' WHEN t LIKE '%GI%' THEN 'G1'
        WHEN t LIKE '%オープン%' THEN 'OP' WHEN t LIKE '%1600万%' THEN '1600' WHEN t LIKE '%未勝利%' THEN '未勝利'
        WHEN t LIKE '%新馬%' THEN '新馬' END AS race_class,
      CASE WHEN t LIKE '2歳%' THEN '2歳' WHEN t LIKE '3歳以上%' THEN '3歳以上' WHEN t LIKE '4歳以上%' THEN '4歳以上'
        WHEN t LIKE '3歳%' THEN '3歳' END AS age_limit""",
    "part", "p_partkey, p_size")

text_rule("prize_list", "F18",
    f"CASE WHEN l_linenumber % 3 = 0 THEN '賞金なし' ELSE concat('2歳 本賞金:', {PART}, ',', {SUPP}, ',', {LINE}, '万円') END",
    lambda t: {f"prize_{i + 1}": c for i, c in enumerate(text.prize_list(t))},
    ", ".join(f"TRY_CAST(nullif(split_part(regexp_extract(t, '本賞金:([0-9,]+)万円', 1), ',', {i}), '') AS INTEGER)"
              f" AS prize_{i}" for i in range(1, 6)))

text_rule("corner_split", "F19",
    f"CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN concat({LINE}, '-(', {SUPP}, ')') ELSE "
    f"concat({LINE}, '-', {SUPP}, '-0-', CAST(1 + l_partkey % 18 AS STRING)) END",
    lambda t: {f"passing_order_{i + 1}": c for i, c in enumerate(text.corners(t))},
    ", ".join(f"nullif(TRY_CAST(regexp_replace(split_part(t, '-', {i}), '[^0-9]', '', 'g') AS INTEGER), 0)"
              f" AS passing_order_{i}" for i in range(1, 5)))

text_rule("running_style", "F20",
    f"CASE l_linenumber % 5 WHEN 0 THEN 'x-1' ELSE concat(CAST(1 + l_partkey % 15 AS STRING), '-1') END",
    lambda t: {"running_style": bands.running_style(text.first_corner(t))},
    """CASE WHEN TRY_CAST(split_part(t, '-', 1) AS INTEGER) IS NULL THEN 'unknown'
      WHEN CAST(split_part(t, '-', 1) AS INTEGER) = 1 THEN 'nige' WHEN CAST(split_part(t, '-', 1) AS INTEGER) <= 4 THEN 'senko'
      WHEN CAST(split_part(t, '-', 1) AS INTEGER) <= 10 THEN 'sashi' ELSE 'oikomi' END AS running_style""")


@query("distance_bands", "F21 F22", """
  SELECT p_partkey, CASE WHEN d IS NULL THEN 'unknown' WHEN d < 1400 THEN 'sprint' WHEN d < 1800 THEN 'mile'
           WHEN d < 2200 THEN 'intermediate' WHEN d < 2800 THEN 'long' ELSE 'marathon' END AS half_open,
         CASE WHEN d <= 1400 THEN 'sprint' WHEN d <= 1800 THEN 'mile' WHEN d <= 2200 THEN 'intermediate'
           WHEN d <= 3000 THEN 'long' WHEN d <= 4000 THEN 'extreme_long' END AS right_closed
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 980 + 70 * p_size END AS d FROM part)""")
def distance_bands(spark, sf):
    d = F.when(F.col("p_partkey") % 11 != 0, 980 + 70 * F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", bands.distance_half_open(d).alias("half_open"),
                                           bands.distance_right_closed(d).alias("right_closed"))


@query("race_condition_bands", "F23", """
  SELECT o_orderkey, CASE WHEN n <= 10 THEN 'small' WHEN n <= 14 THEN 'medium' WHEN n <= 18 THEN 'large'
           WHEN n <= 24 THEN 'extra_large' END AS field_size_category,
         month(o_orderdate) AS race_month,
         CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring'
              WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS race_season,
         CASE WHEN p >= 2000 THEN 'high' WHEN p >= 1000 THEN 'medium' ELSE 'low' END AS race_importance
  FROM (SELECT *, 1 + o_custkey % 30 AS n, coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 100 END, 500) AS p
        FROM orders)""")
def race_condition_bands(spark, sf):
    month = F.month("o_orderdate")
    prize = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 100)
    return table(spark, sf, "orders").select(
        "o_orderkey", bands.field_size(1 + F.col("o_custkey") % 30).alias("field_size_category"),
        month.alias("race_month"), bands.season(month).alias("race_season"),
        bands.importance(prize).alias("race_importance"))


@query("derived_result_measures", "F24", with_entrants(f"""
  SELECT {K}, round((finish_time_seconds - last_3f_time) / (last_3f_time + 0.1), 6) AS pace_index,
         passing_order_4 - passing_order_1 AS position_change,
         finish_position - passing_order_4 AS final_corner_to_finish,
         finish_position - popularity AS popularity_finish_diff,
         round(1 / (win_odds + 1), 6) AS win_probability FROM entrants"""))
def derived_result_measures(spark, sf):
    df = entrants(spark, sf, [*KEY, "finish_time_seconds", "last_3f_time", "passing_order_1", "passing_order_4",
                              "finish_position", "popularity", "win_odds"])
    before = F.col("finish_time_seconds") - F.col("last_3f_time")
    return df.select(
        *KEY, F.round(bands.pace_index(before, F.col("last_3f_time")), 6).alias("pace_index"),
        (F.col("passing_order_4") - F.col("passing_order_1")).alias("position_change"),
        (F.col("finish_position") - F.col("passing_order_4")).alias("final_corner_to_finish"),
        (F.col("finish_position") - F.col("popularity")).alias("popularity_finish_diff"),
        F.round(bands.implied_probability(F.col("win_odds")), 6).alias("win_probability"))


@query("row_null_count", "F25", with_entrants(f"""
  SELECT {K}, CAST(prize_money IS NULL AS INTEGER) + CAST(nullif(popularity, 1) IS NULL AS INTEGER)
           + CAST(nullif(sex, 'O') IS NULL AS INTEGER) AS null_count FROM entrants"""))
def row_null_count(spark, sf):
    df = entrants(spark, sf, [*KEY, "prize_money", "popularity", "sex"])
    df = df.withColumn("popularity", F.nullif(F.col("popularity"), F.lit(1).cast("long")))
    df = df.withColumn("sex", F.nullif(F.col("sex"), F.lit("O")))
    return df.select(*KEY, bands.null_count(["prize_money", "popularity", "sex"]).alias("null_count"))


@query("expected_value", "F26", with_entrants(f"""
  SELECT {K}, round(win_probability * win_odds, 6) AS ev, round(win_probability * win_odds, 9) > 1.0 AS recommended,
         round(1 / win_odds, 6) AS break_even, round(win_probability * (win_odds + 2), 7) AS ev_if_longer
  FROM entrants"""))
def expected_value(spark, sf):
    df = entrants(spark, sf, [*KEY, "win_probability", "win_odds"])
    p, odds = F.col("win_probability"), F.col("win_odds")
    ev = bands.expected_value(p, odds)
    return df.select(*KEY, F.round(ev, 6).alias("ev"), (F.round(ev, 9) > 1.0).alias("recommended"),
                     F.round(bands.break_even(odds), 6).alias("break_even"),
                     F.round(bands.expected_value(p, odds + 2), 7).alias("ev_if_longer"))


@query("content_hash", "F27", "SELECT doc_id, sha256(text) AS sha256, substr(sha256(text), 1, 8) AS version FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.content_hash(F.col("text")).alias("sha256"), text.short_hash(F.col("text")).alias("version"))


@query("parse_log_lines", "F28 S10", f"""WITH {LOG_SQL}
  SELECT event_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S.%g') AS logged_at, module, level, message, FALSE AS short_form
  FROM log UNION ALL SELECT event_id, strftime(logged_at, '%Y-%m-%d %H:%M:%S.%g'), NULL, level, message, TRUE FROM log""")
def parse_log_lines(spark, sf):
    full = log_lines(spark, sf)
    short = full.withColumn("line", F.regexp_replace("line", " - mod[0-9]+ - ", " - "))
    parsed = (full.withColumn("p", text.log_line(F.col("line"))).withColumn("short_form", F.lit(False))
              .unionByName(short.withColumn("p", text.log_line(F.col("line"), with_module=False))
                           .withColumn("short_form", F.lit(True))))
    return parsed.select("event_id", F.date_format("p.logged_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("logged_at"),
                         "p.module", "p.level", "p.message", "short_form")


@query("freshness_test", "F29", """
  SELECT u.user_id, coalesce(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-31') > 3, true) AS stale
  FROM (SELECT DISTINCT user_id FROM events) u
  LEFT JOIN events e ON u.user_id = e.user_id AND e.event_type = 'purchase' GROUP BY u.user_id""")
def freshness_test(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts").cast("date"))).alias("last_seen"))
    return last.select("user_id", bands.is_stale(F.col("last_seen"), F.lit("2024-01-31").cast("date"), 3).alias("stale"))


text_rule("race_number_from_id", "F30",
    f"concat('2024', lpad({PART}, 6, '0'), CASE WHEN l_linenumber = 3 THEN 'x1' ELSE lpad({LINE}, 2, '0') END)",
    lambda t: {"race_number": text.race_number(t)},
    "TRY_CAST(right(t, 2) AS INTEGER) AS race_number")


@query("date_range_batches", "F31", """
  SELECT o_custkey, CAST(CAST(s AS DATE) AS STRING) AS span_start,
         CAST(least(CAST(s AS DATE) + 89, b) AS STRING) AS span_end
  FROM (SELECT o_custkey, a, b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 90 DAY)) AS s
        FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b
              FROM orders GROUP BY o_custkey))""")
def date_range_batches(spark, sf):
    span = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return span.select("o_custkey", F.explode(bands.date_spans(F.col("a"), F.col("b"), 90)).alias("s")).select(
        "o_custkey", F.col("s.span_start").cast("string").alias("span_start"),
        F.col("s.span_end").cast("string").alias("span_end"))


@query("usable_odds", "F32", """
  SELECT o_orderkey, key, CAST(odds AS DOUBLE) AS odds FROM (
    SELECT o_orderkey, 'a' AS key, o_custkey % 5 AS odds FROM orders UNION ALL
    SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END FROM orders)
  WHERE odds IS NOT NULL AND odds <> 0""")
def usable_odds(spark, sf):
    def quote(value):
        return F.struct(value.cast("double").alias("odds"), F.lit(1).alias("popularity"))

    odds = F.create_map(F.lit("a"), quote(F.col("o_custkey") % 5),
                        F.lit("b"), quote(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))))
    return table(spark, sf, "orders").select("o_orderkey", F.explode(bands.usable_odds(odds)).alias("key", "odds"))


@query("months_touched", "F33", """
  SELECT o_custkey, strftime(m, '%Y-%m') AS month FROM (
    SELECT o_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m
    FROM orders GROUP BY o_custkey)""")
def months_touched(spark, sf):
    span = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.col("o_orderdate").cast("date")).alias("a"), F.max(F.col("o_orderdate").cast("date")).alias("b"))
    return span.select("o_custkey", F.explode(bands.months_touched(F.col("a"), F.col("b"))).alias("m")).select(
        "o_custkey", F.date_format("m", "yyyy-MM").alias("month"))
