"""The race view over the given order tables.

An order is a race, each of its lines an entrant; the part is the horse, the
supplier the jockey, the customer the trainer and the customer's nation the
venue. Measures are plain arithmetic on the line so that they are repeatable.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceflow import skew

KEY = ["race_id", "horse_id", "jockey_id", "bracket_number"]
# a horse's own rows in time order, unique
TIMELINE = ["race_date", "race_id", "jockey_id", "bracket_number"]

_ORDERS = {"trainer_id", "race_date"}
_NATION = {"venue"}
_PART = {"sire_id", "damsire_id", "distance_m"}
_LINE = {
    "race_id": "l_orderkey",
    "horse_id": "l_partkey",
    "jockey_id": "l_suppkey",
    "bracket_number": "l_linenumber",
    "track_surface": "l_returnflag",
    "sex": "l_linestatus",
    "age": "2 + l_linenumber % 5",
    "finish_time_seconds": "floor(l_extendedprice / 100) / 10.0D",
    "last_3f_time": "33 + floor(l_quantity) / 10.0D",
    "win_odds": "1 + l_quantity / 2",
    "morning_odds": "1 + l_quantity / 4",
    "basis_weight": "50 + floor(l_tax * 100 + 0.5D)",
    "horse_weight": "400 + l_suppkey % 120",
    "predicted_score": "floor(l_quantity * (1 - l_discount) * 10) / 10.0D",
    "predicted_time": "floor(l_extendedprice * (1 - l_discount) / 100) / 10.0D",
    "passing_order_1": "1 + (l_partkey + l_linenumber) % 14",
    "passing_order_4": "1 + (l_partkey + 3 * l_linenumber) % 14",
}
_IN_RACE = {"finish_position", "prize_money", "popularity", "head_count", "horse_number",
            "win_probability", "is_win", "is_winner"}
_DIMENSION = {
    "trainer_id": "o_custkey",
    "race_date": "cast(o_orderdate AS date)",
    "venue": "n_name",
    "sire_id": "p_brand",
    "damsire_id": "p_type",
    "distance_m": "1000 + 60 * p_size",
}

# The same view for the oracle.
ENTRANTS_SQL = """entrants AS (
  SELECT *, CASE WHEN finish_position = 1 THEN 1 ELSE 0 END AS is_win,
         CASE WHEN finish_position <= 5 THEN prize_base END AS prize_money,
         (1.0 / win_odds) / sum(1.0 / win_odds) OVER (PARTITION BY race_id) AS win_probability
  FROM (
    SELECT l_orderkey AS race_id, l_partkey AS horse_id, l_suppkey AS jockey_id,
           l_linenumber AS bracket_number, o_custkey AS trainer_id, n_name AS venue,
           CAST(o_orderdate AS DATE) AS race_date, p_brand AS sire_id, p_type AS damsire_id,
           1000 + 60 * p_size AS distance_m, l_returnflag AS track_surface, l_linestatus AS sex,
           2 + l_linenumber % 5 AS age,
           CAST(floor(l_extendedprice / 100) / 10.0 AS DOUBLE) AS finish_time_seconds,
           CAST(33 + floor(l_quantity) / 10.0 AS DOUBLE) AS last_3f_time,
           1 + l_quantity / 2 AS win_odds, 1 + l_quantity / 4 AS morning_odds,
           CAST(50 + floor(l_tax * 100 + 0.5) AS BIGINT) AS basis_weight,
           400 + l_suppkey % 120 AS horse_weight,
           CAST(floor(l_quantity * (1 - l_discount) * 10) / 10.0 AS DOUBLE) AS predicted_score,
           CAST(floor(l_extendedprice * (1 - l_discount) / 100) / 10.0 AS DOUBLE) AS predicted_time,
           1 + (l_partkey + l_linenumber) % 14 AS passing_order_1,
           1 + (l_partkey + 3 * l_linenumber) % 14 AS passing_order_4,
           floor(l_extendedprice * (1 - l_discount) / 100) AS prize_base,
           row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber) AS finish_position,
           row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_partkey, l_suppkey, l_linenumber) AS horse_number,
           rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS popularity,
           count(*) OVER (PARTITION BY l_orderkey) AS head_count
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey))"""


def with_entrants(body: str) -> str:
    """Oracle text starting from the race view."""
    return f"WITH {ENTRANTS_SQL} {body}"


_HOT: dict[tuple, list[tuple]] = {}


def hot_in(spark: SparkSession, sf: str, table: str, column: str) -> list[tuple]:
    """Hot keys of a base column, remembered per session (a stale list only
    changes the physical plan)."""
    floor = skew.hot_rows_setting(spark)
    key = (spark.sparkContext.applicationId, sf, table, column, floor)
    if key not in _HOT:
        df = spark.read.parquet(f"{sf}/{table}.parquet").select(column)
        _HOT[key] = skew.hot_keys(df, [column], floor)
    return _HOT[key]


def hot_races(spark, sf):
    return hot_in(spark, sf, "lineitem", "l_orderkey")


def hot_horses(spark, sf):
    return hot_in(spark, sf, "lineitem", "l_partkey")


def hot_jockeys(spark, sf):
    return hot_in(spark, sf, "lineitem", "l_suppkey")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entrants(spark: SparkSession, sf: str, columns: Iterable[str]) -> DataFrame:
    """The race view with exactly ``columns``, joining only what they need."""
    want = list(dict.fromkeys(columns))
    need = set(want)
    unknown = need - set(_LINE) - _ORDERS - _NATION - _PART - _IN_RACE
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    df = table(spark, sf, "lineitem")
    if need & _IN_RACE:
        df = skew.by_part(df, ["l_orderkey"], hot_races(spark, sf), lambda rows, hot: _in_race(rows, need, hot))
    if need & (_ORDERS | _NATION):
        orders = table(spark, sf, "orders")
        if need & _NATION:
            customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
            nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
            orders = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
                      .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if need & _PART:
        df = df.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    exprs = {**_LINE, **_DIMENSION}
    return df.select(*[F.expr(exprs[c]).alias(c) if c in exprs else F.col(c) for c in want])


def _in_race(df: DataFrame, need: set[str], hot) -> DataFrame:
    race = ["l_orderkey"]
    line = ["l_partkey", "l_suppkey", "l_linenumber"]
    if need & {"head_count", "win_probability"}:
        inverse = F.lit(1.0) / (1 + F.col("l_quantity") / 2)
        df = skew.over_group(df, race, {"head_count": F.count(F.lit(1)), "_inv": F.sum(inverse)}, hot)
        df = df.withColumn("win_probability", inverse / F.col("_inv"))
    if need & {"finish_position", "prize_money", "is_win", "is_winner"}:
        df = skew.row_numbers(df, race, ["l_extendedprice", *line], "finish_position", hot)
        won = (F.col("finish_position") == 1).cast("int")
        prize = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 100).cast("double")
        df = df.withColumns({"is_win": won, "is_winner": won,
                             "prize_money": F.when(F.col("finish_position") <= 5, prize)})
    if "horse_number" in need:
        df = skew.row_numbers(df, race, line, "horse_number", hot)
    if "popularity" in need:
        df = skew.rank_within(df, race, "l_quantity", "popularity", hot=hot)
    return df


# Log text built from the events; the same expressions serve Spark and the oracle.
_LOG_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END"
_LOG_MESSAGE = """CASE event_id % 12
  WHEN 0 THEN 'race scraping completed'
  WHEN 1 THEN concat('race scraping failed: http ', CAST(400 + user_id % 5 AS STRING))
  WHEN 2 THEN 'shutuba scraping skip'
  WHEN 3 THEN 'horse scraping success'
  WHEN 4 THEN 'pedigree scraping error, retrying'
  WHEN 5 THEN concat('race parsing completed in ', CAST(1 + user_id % 40 AS STRING), '.5 seconds')
  WHEN 6 THEN 'shutuba parsing failed'
  WHEN 7 THEN 'horse parsing success'
  WHEN 8 THEN concat('pedigree parsing error: missing field: column', CAST(user_id % 20 AS STRING))
  WHEN 9 THEN concat('Scraping ', CAST(1 + user_id AS STRING), ' items in ', CAST(1 + user_id % 7 AS STRING), ' seconds')
  WHEN 10 THEN concat(CASE user_id % 3 WHEN 0 THEN 'distance' WHEN 1 THEN 'venue' ELSE 'weather' END, ' not found')
  ELSE concat('pipeline completed in ', CAST(10 + user_id AS STRING), ' seconds') END"""
LOG_SQL = f"""log AS (SELECT event_id, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS logged_at,
  concat('mod', CAST(user_id % 5 AS STRING)) AS module, {_LOG_LEVEL} AS level, {_LOG_MESSAGE} AS message,
  concat(strftime(ts, '%Y-%m-%d %H:%M:%S,%g'), ' - mod', CAST(user_id % 5 AS STRING), ' - ', {_LOG_LEVEL},
         ' - ', {_LOG_MESSAGE}) AS line FROM events)"""


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """event_id and one log line of text per event."""
    stamp = "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')"
    return table(spark, sf, "events").selectExpr(
        "event_id", f"concat({stamp}, ' - mod', CAST(user_id % 5 AS STRING), ' - ', {_LOG_LEVEL}, ' - ', "
        f"{_LOG_MESSAGE}) AS line")
