"""Joins and set operations."""

from pyspark.sql import functions as F

from raceflow.bindings import KEY, entrants, table, with_entrants
from raceflow.operators import ingroup, keys, staking
from raceflow.registry import query
from raceflow.sources.pages import link_ids

K = "race_id, horse_id, jockey_id, bracket_number"
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("left_lookup_join", "J1", """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_brand, p_type
  FROM lineitem LEFT JOIN part ON CASE WHEN l_linenumber <> 4 THEN l_partkey END = p_partkey""")
def left_lookup_join(spark, sf):
    """Every fourth line names no part, and so finds none."""
    profile = table(spark, sf, "part").select(F.col("p_partkey").alias("named"), "p_brand", "p_type")
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, F.when(F.col("l_linenumber") != 4, F.col("l_partkey")).alias("named"))
    return keys.lookup_left(lines, profile, ["named"]).drop("named")


@query("inner_join_composite_key", "J2", """
  SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.l_quantity, b.l_extendedprice
  FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
   AND a.l_linenumber = CASE WHEN b.l_returnflag <> 'R' THEN b.l_linenumber END""")
def inner_join_composite_key(spark, sf):
    lines = table(spark, sf, "lineitem")
    features = lines.select(*LINE_KEY, "l_quantity")
    number = F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("l_linenumber")
    targets = lines.select(*LINE_KEY[:-1], number, "l_extendedprice")
    return features.join(targets, LINE_KEY, "inner")


@query("replace_column_join", "J3", """
  SELECT o_orderkey, o_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS o_orderpriority FROM orders LEFT JOIN customer
    ON o_custkey = c_custkey""")
def replace_column_join(spark, sf):
    segment = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("o_orderpriority")
    fresh = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), segment)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return keys.replace_from(orders, fresh, ["o_custkey"])


@query("null_safe_statistics_join", "J4", with_entrants(f"""
  SELECT e.race_id, e.horse_id, e.jockey_id, e.bracket_number, s.starts FROM
    (SELECT *, nullif(age, 3) AS a FROM entrants) e LEFT JOIN
    (SELECT jockey_id, nullif(age, 3) AS a, count(*) AS starts FROM entrants GROUP BY ALL) s
    ON e.jockey_id = s.jockey_id AND e.a IS NOT DISTINCT FROM s.a"""))
def null_safe_statistics_join(spark, sf):
    df = entrants(spark, sf, [*KEY, "age"]).withColumn("age", F.when(F.col("age") != 3, F.col("age")))
    stats = df.groupBy("jockey_id", "age").agg(F.count(F.lit(1)).alias("starts"))
    return keys.stats_lookup(df, stats, ["jockey_id", "age"], null_matches=True).drop("age")


@query("fill_nulls_from_table", "J5", """
  SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, c_mktsegment) AS segment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def fill_nulls_from_table(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("segment"))
    source = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                 F.col("c_mktsegment").alias("segment"))
    return keys.fill_from(orders, source, ["o_custkey"], ["segment"]).drop("o_custkey")


@query("work_list", "J6", """
  SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)
     OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def work_list(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return keys.work_list(table(spark, sf, "orders").select("o_orderkey"),
                          lines.filter(F.col("l_linenumber") == 1),
                          lines.filter(F.col("l_returnflag") == "R"), "o_orderkey")


@query("semi_join", "J7", """
  SELECT o_orderkey FROM orders WHERE o_orderdate IN (SELECT DISTINCT l_shipdate FROM lineitem WHERE l_quantity >= 50)""")
def semi_join(spark, sf):
    days = table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 50).select(F.col("l_shipdate").alias("o_orderdate"))
    return table(spark, sf, "orders").join(days, "o_orderdate", "left_semi").select("o_orderkey")


@query("key_coverage", "J8", """
  WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber <= 4),
       b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N'),
       c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O')
  SELECT CAST(k IN (FROM a) AS INTEGER) AS in_a, CAST(k IN (FROM b) AS INTEGER) AS in_b,
         CAST(k IN (FROM c) AS INTEGER) AS in_c, count(*) AS keys
  FROM (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c) GROUP BY ALL""")
def key_coverage(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return keys.key_coverage({
        "a": lines.filter(F.col("l_linenumber") <= 4).select(F.col("l_orderkey").alias("k")),
        "b": lines.filter(F.col("l_returnflag") == "N").select(F.col("l_orderkey").alias("k")),
        "c": orders.filter(F.col("o_orderstatus") == "O").select(F.col("o_orderkey").alias("k"))}, ["k"])


@query("key_overlap_sizes", "J8 D4", """
  WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3),
       b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
  SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS left_only,
         (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS right_only""")
def key_overlap_sizes(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    return keys.overlap_sizes(lines.filter("l_linenumber <= 3"), lines.filter("l_linenumber >= 3"),
                              ["l_partkey", "l_suppkey"])


@query("self_join_through_parent", "J10", """
  SELECT c.p_partkey AS horse_id, c.dam_id, d.sire_id AS damsire_id FROM
    (SELECT p_partkey, CASE WHEN p_partkey > 9 THEN p_partkey // 2 END AS dam_id FROM part) c LEFT JOIN
    (SELECT p_partkey, p_brand AS sire_id FROM part) d ON c.dam_id = d.p_partkey""")
def self_join_through_parent(spark, sf):
    horses = table(spark, sf, "part").selectExpr(
        "p_partkey AS horse_id", "p_brand AS sire_id", "CASE WHEN p_partkey > 9 THEN p_partkey div 2 END AS dam_id")
    return keys.through_parent(horses, "dam_id", "horse_id", "sire_id", "damsire_id").drop("sire_id")


@query("wide_base_table", "J13", """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, p_brand, p_size, s_nationkey
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def wide_base_table(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINE_KEY)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return keys.wide_join(lines, [(orders, ["l_orderkey"], "_entry"), (part, ["l_partkey"], "_profile"),
                                  (supplier, ["l_suppkey"], "_jockey")])


@query("merge_coverage", "J14", """
  SELECT (SELECT count(*) FROM lineitem) AS rows_before, count(*) AS rows_after,
         round(avg(CASE WHEN p_brand IS NOT NULL THEN 1 ELSE 0 END), 6) AS matched,
         count(*) > (SELECT count(*) FROM lineitem) AS grew
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) ON l_partkey = p_partkey""")
def merge_coverage(spark, sf):
    part = table(spark, sf, "part").filter("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    out = keys.match_rate(table(spark, sf, "lineitem").select("l_partkey"), part, ["l_partkey"], "p_brand")
    return out.withColumn("matched", F.round("matched", 6))


@query("upsert_append", "D1", """
  SELECT l_orderkey, l_linenumber, l_partkey, src FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src DESC, l_partkey DESC, l_suppkey DESC) AS r
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0 AS src FROM lineitem WHERE l_returnflag <> 'A'
          UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 FROM lineitem WHERE l_quantity > 25)) WHERE r = 1""")
def upsert_append(spark, sf):
    lines = table(spark, sf, "lineitem")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    old = lines.filter("l_returnflag <> 'A'").select(*columns, F.lit(0).alias("src"))
    new = lines.filter("l_quantity > 25").select(*columns, F.lit(1).alias("src"))
    out = keys.upsert(old, new, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    return out.drop("l_suppkey")


@query("replace_slice", "D2", """
  SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) <> 1997
  UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE year(o_orderdate) = 1997 AND o_orderstatus = 'O'""")
def replace_slice(spark, sf):
    orders = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    new = orders.filter((F.col("y") == 1997) & (F.col("o_orderstatus") == "O")).select(
        "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), "y")
    return keys.replace_slice(orders.select("o_orderkey", "o_totalprice", "y"), new, F.col("y") == 1997).drop("y")


@query("outer_schema_concat", "D3", """
  SELECT o_orderkey AS k, o_totalprice AS price, NULL::VARCHAR AS segment FROM orders
  UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def outer_schema_concat(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return keys.outer_concat(orders, customer)


@query("intersect_and_except_keys", "D4", """
  SELECT 'shared' AS side, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_linenumber = 1
      INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
  UNION ALL SELECT 'missing', k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)""")
def intersect_and_except_keys(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "k")
    first, heavy = lines.filter("l_linenumber = 1"), lines.filter("l_quantity > 45")
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    return (keys.shared_keys(first, heavy, ["k"]).select(F.lit("shared").alias("side"), "k")
            .unionByName(keys.missing_keys(parts, first, ["k"]).select(F.lit("missing").alias("side"), "k")))


@query("distinct_id_harvest", "D5 B15", r"""
  SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS id FROM pages""")
def distinct_id_harvest(spark, sf):
    return link_ids(table(spark, sf, "pages"), "html", r'href="/([^"/]+)"').select("id").distinct()


@query("link_extraction_counts", "B15", r"""
  SELECT id, count(*) AS links, count(DISTINCT page_id) AS pages FROM (
    SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/]+)"', 1)) AS id FROM pages) GROUP BY id""")
def link_extraction_counts(spark, sf):
    links = link_ids(table(spark, sf, "pages"), "html", r'href="/([^"/]+)"')
    per_page = links.groupBy("id", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return per_page.groupBy("id").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))


@query("resolve_errors", "D6", """
  SELECT event_id, user_id FROM events WHERE event_type = 'error'
    AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150)""")
def resolve_errors(spark, sf):
    events = table(spark, sf, "events")
    return keys.resolve_errors(events.filter("event_type = 'error'").select("event_id", "user_id"),
                               events.filter("event_type = 'signup' AND value > 150"), "user_id")


@query("probability_odds_join", "J11", with_entrants("""
  SELECT race_id, market, CAST(horse_number AS STRING) AS key, round(probability, 7) AS probability, odds FROM (
    SELECT race_id, horse_number, 'win' AS market, win_probability AS probability, win_odds AS odds FROM entrants
    UNION ALL SELECT race_id, horse_number, 'place', least(1.0, 3 * win_probability), 1 + win_odds / 4 FROM entrants
      WHERE horse_number <= 4)"""))
def probability_odds_join(spark, sf):
    runners = entrants(spark, sf, ["race_id", "horse_number", "win_probability", "win_odds"])
    key = F.col("horse_number").cast("string").alias("key")
    p = F.col("win_probability")
    probabilities = runners.select("race_id", F.lit("win").alias("market"), key, p.alias("probability")).unionByName(
        runners.select("race_id", F.lit("place"), key, F.least(F.lit(1.0), 3 * p)).toDF(
            "race_id", "market", "key", "probability"))
    odds = runners.select("race_id", F.lit("win").alias("market"), key, F.col("win_odds").alias("odds")).unionByName(
        runners.filter("horse_number <= 4").select(
            "race_id", F.lit("place").alias("market"), key, (1 + F.col("win_odds") / 4).alias("odds")))
    out = staking.priced(probabilities, odds)
    return out.select("race_id", "market", "key", F.round("probability", 7).alias("probability"), "odds")


@query("pick_versus_winner", "J12", with_entrants("""
  SELECT p.race_id, p.horse_number AS picked, w.horse_number AS winner, p.horse_number = w.horse_number AS hit, w.win_odds
  FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY predicted_score, horse_number) AS r FROM entrants) p
  LEFT JOIN (SELECT * FROM entrants WHERE finish_position = 1) w ON p.race_id = w.race_id WHERE r = 1"""))
def pick_versus_winner(spark, sf):
    runners = entrants(spark, sf, ["race_id", "horse_number", "predicted_score", "finish_position", "win_odds"])
    picks = ingroup.best_row(runners, "race_id", "predicted_score", ["horse_number"]).select(
        "race_id", F.col("horse_number").alias("picked"))
    winners = ingroup.best_row(runners.filter("finish_position = 1"), "race_id", "horse_number", ["win_odds"]).select(
        "race_id", F.col("horse_number").alias("winner"), "win_odds")
    return picks.join(winners, "race_id", "left").withColumn("hit", F.col("picked") == F.col("winner"))
