"""Outcome probabilities, bets and stakes, lineage."""

from pyspark.sql import functions as F

from raceflow import skew
from raceflow.bindings import entrants, hot_races, table, with_entrants
from raceflow.operators import outcomes, pedigree, staking
from raceflow.registry import query


def _outcomes(spark, sf):
    """win probability and a place value of three times it, at most 1."""
    df = entrants(spark, sf, ["race_id", "horse_number", "win_probability"])
    return df.select("race_id", F.col("horse_number").alias("runner"), F.col("win_probability").alias("win"),
                     F.least(F.lit(1.0), 3 * F.col("win_probability")).alias("place"))


@query("packed_probability_maps", "B4", with_entrants("""
  SELECT race_id, CAST(horse_number AS STRING) AS key, round(win_probability, 7) AS probability, head_count AS entries FROM entrants"""))
def packed_probability_maps(spark, sf):
    df = entrants(spark, sf, ["race_id", "horse_number", "win_probability"])
    docs = outcomes.pack(df, "race_id", "horse_number", "win_probability", "win_probs", parts=4)
    sizes = docs.groupBy("race_id").agg(F.sum(F.size("win_probs")).alias("entries"))
    out = outcomes.unpack(docs, "race_id", "win_probs").join(sizes, "race_id")
    return out.withColumn("probability", F.round("probability", 7))


@query("probability_audit", "B5", with_entrants("""
  SELECT race_id, round(sum(win_probability) + 1e-9, 5) AS win, round(sum(least(1.0, 3 * win_probability)) + 1e-9, 5) AS place,
         count(*) AS runners, abs(sum(win_probability) - 1) <= 0.01
           AND abs(sum(least(1.0, 3 * win_probability)) - least(3, count(*))) <= 0.01 AS fits FROM entrants GROUP BY race_id"""))
def probability_audit(spark, sf):
    out = outcomes.audit(_outcomes(spark, sf))
    return out.select("race_id", *[F.round(F.col(c) + F.lit(1e-9), 5).alias(c) for c in ("win", "place")], "runners", "fits")


_ORDERS = """ranked AS (
    SELECT race_id, horse_number AS k, win_probability AS p,
           row_number() OVER (PARTITION BY race_id ORDER BY win_probability DESC, horse_number) AS r FROM entrants),
  orders_of AS (
    SELECT a.race_id, [a.k, b.k, c.k] AS runners, [a.r, b.r, c.r] AS ranks,
           round(a.p * (b.p / (1 - a.p)) * (c.p / (1 - a.p - b.p)), 12) AS probability
    FROM ranked a JOIN ranked b ON a.race_id = b.race_id AND a.k <> b.k JOIN ranked c ON a.race_id = c.race_id AND c.k <> a.k AND c.k <> b.k)"""


@query("top_orders_per_race", "O3", with_entrants("").rstrip() + f""", {_ORDERS}
  SELECT race_id, place, array_to_string(runners, '-') AS runners, round(probability + 1e-13, 9) AS probability FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY probability DESC, ranks) AS place FROM orders_of) WHERE place <= 20""")
def top_orders_per_race(spark, sf):
    """The twenty most probable first three of each race, from the win probabilities."""
    out = outcomes.top_orders(_outcomes(spark, sf), top=20, length=3)
    return out.select("race_id", "place", F.concat_ws("-", F.col("runners").cast("array<string>")).alias("runners"),
                      F.round(F.col("probability") + F.lit(1e-13), 9).alias("probability"))


_PRICED = """priced AS (
    SELECT race_id, 'win' AS market, horse_number AS key, win_probability AS p, morning_odds * 1.7::DOUBLE AS odds FROM entrants
    UNION ALL SELECT race_id, 'place', horse_number, least(1.0, 3 * win_probability), 1 + win_odds / 3 FROM entrants)"""


def _priced(spark, sf):
    df = entrants(spark, sf, ["race_id", "horse_number", "win_probability", "win_odds", "morning_odds"])
    p, key = F.col("win_probability"), F.col("horse_number").alias("key")
    win = df.select("race_id", F.lit("win").alias("market"), key, p.alias("probability"), (F.col("morning_odds") * 1.7).alias("odds"))
    place = df.select("race_id", F.lit("place").alias("market"), key, F.least(F.lit(1.0), 3 * p).alias("probability"),
                      (1 + F.col("win_odds") / 3).alias("odds"))
    return win.unionByName(place)


@query("bet_candidates", "B6", with_entrants("").rstrip() + f""", {_PRICED}
  SELECT race_id, market, key, round(p * odds + 1e-9, 6) AS ev, 1000.0::DOUBLE AS cap FROM priced
  WHERE p * odds >= 1.2000001 AND p >= 0.0100001 AND odds >= 1""")
def bet_candidates(spark, sf):
    out = staking.candidates(_priced(spark, sf), min_ev=1.2000001, min_probability=0.0100001)
    return out.select("race_id", "market", "key", F.round(F.col("ev") + F.lit(1e-9), 6).alias("ev"), "cap")


_KELLY = "greatest(0.0, least(1.0, (p * odds - 1) / (odds - 1)))"
_GROWTH = (f"CASE WHEN odds > 1 AND p * odds > 1.1000001 AND {_KELLY} > 0 THEN p * ln(1 + {_KELLY} * (odds - 1)) "
           f"+ CASE WHEN {_KELLY} < 1 THEN (1 - p) * ln(1 - {_KELLY}) ELSE 0 END END")


@query("kelly_growth_score", "B7", with_entrants("").rstrip() + f""", {_PRICED}
  SELECT race_id, round(coalesce(sum({_GROWTH}), 0), 6) AS score FROM (SELECT * FROM priced WHERE market = 'win') GROUP BY race_id""")
def kelly_growth_score(spark, sf):
    scores = staking.race_scores(_priced(spark, sf).filter("market = 'win'"), 1.1000001)
    return scores.withColumn("score", F.round("score", 6))


@query("proportional_budget", "B8", with_entrants("").rstrip() + f""", {_PRICED}, s AS (
    SELECT race_id, round(coalesce(sum({_GROWTH}), 0), 6) AS score FROM (SELECT * FROM priced WHERE market = 'win') GROUP BY race_id)
  SELECT race_id, CASE WHEN score > 0 THEN floor(100000000.0 * score / (SELECT sum(score) FROM s WHERE score > 0) / 100) * 100
    ELSE 0 END::DOUBLE AS budget FROM s""")
def proportional_budget(spark, sf):
    scores = staking.race_scores(_priced(spark, sf).filter("market = 'win'"), 1.1000001)
    return staking.proportional_budget(scores.withColumn("score", F.round("score", 6)), 100_000_000).select("race_id", "budget")


@query("stake_allocation", "B9", with_entrants("").rstrip() + f""", {_PRICED}, c AS (
    SELECT *, least(1000.0, 0.2 * 20000 * {_KELLY}) AS want FROM priced WHERE p * odds >= 1.2000001 AND p >= 0.0100001 AND odds > 1)
  SELECT race_id, market, key, floor(round(want * least(1.0, 2500.0 / sum(want) OVER (PARTITION BY race_id)), 6) / 100) * 100 AS amount FROM c""")
def stake_allocation(spark, sf):
    bets = staking.candidates(_priced(spark, sf), min_ev=1.2000001, min_probability=0.0100001)
    out = staking.stakes(bets, 20_000, 0.2, race_cap=2500, hot=hot_races(spark, sf))
    return out.select("race_id", "market", "key", "amount")


# ---- lineage: edges spelled from the part keys ---------------------------------

_EDGES = """edges AS (
  SELECT p_partkey AS horse_id, g AS generation, p AS seq, concat('a', CAST((p_partkey * (2 * g + 1) + 31 * p) % 5000 AS STRING)) AS ancestor_id,
         CASE WHEN (p_partkey + p) % 4 <> 0 THEN 1990 + (p_partkey * p) % 20 END AS birth_year
  FROM part, (SELECT unnest(generate_series(1, 5)) AS g), (SELECT unnest(generate_series(1, 32)) AS p)
  WHERE p <= 1 << g AND (p_partkey + g + p) % 13 <> 0)"""


def _edges(spark, sf):
    g = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("generation")
    # 62 edges a horse at most: dealt before they are made, so that a task makes and sorts some 500,000 whatever the files
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"))
    parts = skew.dealt(parts, ["horse_id"], parts.count(), skew.TASK_ROWS // 62)
    df = parts.select("horse_id", g)
    df = df.withColumn("seq", F.explode(F.expr("sequence(1, shiftleft(1, generation))")))
    df = df.filter("(horse_id + generation + seq) % 13 <> 0")
    return df.withColumns({
        "ancestor_id": F.expr("concat('a', CAST((horse_id * (2 * generation + 1) + 31 * seq) % 5000 AS STRING))"),
        "birth_year": F.expr("CASE WHEN (horse_id + seq) % 4 <> 0 THEN 1990 + (horse_id * seq) % 20 END")})


@query("pedigree_wide_form", "B11 W19", f"""WITH {_EDGES}, n AS (
    SELECT *, row_number() OVER (PARTITION BY horse_id, generation ORDER BY seq) AS position FROM edges)
  SELECT horse_id, """ + ", ".join(
    f"min(ancestor_id) FILTER (generation = {g} AND position = {p}) AS g{g}_p{p}_id"
    for g in (1, 2, 3, 4, 5) for p in range(1, 2 ** g + 1)) + " FROM n GROUP BY horse_id")
def pedigree_wide_form(spark, sf):
    placed = pedigree.positions(_edges(spark, sf), "horse_id", "generation", ["seq"])
    return pedigree.wide(placed, "horse_id", "generation", "position", "ancestor_id", generations=5)


@query("parents_from_edges", "B12", f"""WITH {_EDGES}
  SELECT horse_id, max(ancestor_id) FILTER (generation = 1 AND seq = 1) AS sire_id,
         max(ancestor_id) FILTER (generation = 1 AND seq = 2) AS dam_id,
         max(ancestor_id) FILTER (generation = 2 AND seq = 3) AS damsire_id
  FROM edges GROUP BY horse_id HAVING count(*) FILTER (generation = 1) > 0""")
def parents_from_edges(spark, sf):
    e = _edges(spark, sf)
    out = pedigree.parents(e, "horse_id", "generation", "seq", "ancestor_id")
    return out.join(pedigree.dams_sire(e, "horse_id", "generation", "seq", "ancestor_id"), "horse_id", "left")


@query("pedigree_depth_profile", "B13", f"""WITH {_EDGES}
  SELECT generation, CAST(sum(n) AS BIGINT) AS rows, count(*) AS entities, round(avg(n), 6) AS mean_ancestors,
         round(avg(CASE WHEN n = 1 << generation THEN 1 ELSE 0 END), 6) AS complete
  FROM (SELECT horse_id, generation, count(*) AS n FROM edges GROUP BY ALL) GROUP BY generation""")
def pedigree_depth_profile(spark, sf):
    out = pedigree.depth_profile(_edges(spark, sf), "horse_id", "generation")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ancestors", "complete")})


@query("newest_ancestor_row", "B14", f"""WITH {_EDGES}
  SELECT horse_id, generation, ancestor_id, seq, birth_year FROM (
    SELECT * EXCLUDE (ancestor_id), ancestor_id, row_number() OVER (PARTITION BY horse_id, generation, ancestor_id
      ORDER BY birth_year DESC NULLS LAST, seq) AS r
    FROM (SELECT * REPLACE (substr(ancestor_id, 1, 2) AS ancestor_id) FROM edges)) WHERE r = 1""")
def newest_ancestor_row(spark, sf):
    e = _edges(spark, sf).withColumn("ancestor_id", F.substring("ancestor_id", 1, 2))
    return pedigree.newest_per_ancestor(e, "horse_id", "generation", "ancestor_id", "birth_year", ["seq"])


# ---- stakes on exclusive outcomes, ancestors of any depth ------------------------

@query("exclusive_kelly_stakes", "B9", with_entrants("").rstrip() + f""", {_PRICED}, w AS (
    SELECT race_id, key, p, odds, sum(p) OVER o AS taken, sum(1 / odds) OVER o AS covered FROM priced WHERE market = 'win'
    WINDOW o AS (PARTITION BY race_id ORDER BY p * odds DESC, key ROWS UNBOUNDED PRECEDING)), r AS (
    SELECT race_id, least(1.0, coalesce(min(greatest(0.0, 1 - taken) / (1 - covered)) FILTER (covered < 1), 1.0)) AS reserve
    FROM w GROUP BY race_id), s AS (SELECT *, greatest(0.0, p - reserve / odds) AS share FROM w JOIN r USING (race_id))
  SELECT race_id, key, round(share + 1e-10, 7) AS share, round(reserve + 1e-10, 7) AS reserve,
         round(coalesce(sum(CASE WHEN share > 0 THEN p * ln(p * odds) END) OVER g
           + CASE WHEN reserve > 0 THEN (1 - sum(CASE WHEN share > 0 THEN p END) OVER g) * ln(reserve) ELSE 0 END, 0) + 1e-10, 7) AS growth
  FROM s WINDOW g AS (PARTITION BY race_id)""")
def exclusive_kelly_stakes(spark, sf):
    """Growth-optimal stakes on all winners of a race at once."""
    win = _priced(spark, sf).filter("market = 'win'")
    out = staking.exclusive_stakes(win, hot=hot_races(spark, sf))
    return out.select("race_id", "key", *[F.round(F.col(c) + F.lit(1e-10), 7).alias(c) for c in ("share", "reserve", "growth")])


@query("ancestors_of_any_depth", "B11 B13", """WITH RECURSIVE parentage AS (
    SELECT p_partkey AS horse_id, unnest([p_partkey // (2 + p_size % 2), p_partkey // (4 + p_size % 3)]) AS parent_id FROM part),
  known AS (SELECT * FROM parentage WHERE parent_id > 0),
  lines AS (SELECT horse_id, parent_id AS ancestor, 1 AS distance FROM known
    UNION ALL SELECT l.horse_id, k.parent_id, distance + 1 FROM lines l JOIN known k ON l.ancestor = k.horse_id)
  SELECT horse_id, ancestor, distance, paths, paths * pow(0.5, distance) AS share FROM (
    SELECT horse_id, ancestor, distance, count(*)::DOUBLE AS paths FROM lines GROUP BY ALL)""")
def ancestors_of_any_depth(spark, sf):
    """All ancestors of every part key, its parents being smaller keys."""
    parents = F.explode(F.expr("array(p_partkey div (2 + p_size % 2), p_partkey div (4 + p_size % 3))")).alias("parent_id")
    parentage = table(spark, sf, "part").select(F.col("p_partkey").alias("horse_id"), parents).filter("parent_id > 0")
    return pedigree.ancestors(parentage, "horse_id", "parent_id")
