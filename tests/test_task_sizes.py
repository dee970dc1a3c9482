"""What a task gets and what is written does not outgrow the input."""

import math
import random
import statistics

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.bindings import KEY, TIMELINE, entrants
from raceflow.catalog import files as files_catalog
from raceflow.catalog import learning as learning_catalog
from raceflow.catalog import outcomes as outcomes_catalog
from raceflow.operators import metrics, outcomes, pedigree, timeline
from raceflow.plans import features, learning
from raceflow.sources import files


def test_edges_are_dealt_before_they_are_made(spark, tmp_path, monkeypatch):
    spark.range(1, 1001).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(skew, "TASK_ROWS", 62 * 50)
    edges = outcomes_catalog._edges(spark, str(tmp_path))
    assert edges.rdd.getNumPartitions() == 20
    newest = pedigree.newest_per_ancestor(edges, "horse_id", "generation", "ancestor_id", "birth_year", ["seq"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the parts; the edges stay where they are made


def _races(spark):
    return spark.range(1200).select((F.col("id") % 150).alias("race"), (F.col("id") * 7 % 11).alias("score"), (F.col("id") % 8).alias("finish"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("a"), (F.col("id") % 2).alias("b"))


def _alike(got, want):
    assert [row[:3] for row in got] == [row[:3] for row in want]
    assert all(math.isclose(g, w, abs_tol=1e-12) for a, b in zip(got, want) for g, w in zip(a[3:], b[3:]))


def test_segments_are_dealt_by_their_rows(spark, monkeypatch):
    def report():
        return metrics.segment_report(_races(spark), "race", {"a": F.col("a"), "b": F.col("b")}, "score", "finish")

    want = sorted(map(tuple, report().collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    dealt = report()
    assert ", 24), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    _alike(sorted(map(tuple, dealt.collect())), want)
    assert len(want) == 7


def test_segments_with_hot_races(spark):
    want = sorted(map(tuple, metrics.segment_report(_races(spark), "race", {"b": F.col("b")}, "score", "finish").collect()))
    spark.conf.set("spark.raceflow.hotRows", "4")
    try:
        got = sorted(map(tuple, metrics.segment_report(_races(spark), "race", {"b": F.col("b")}, "score", "finish").collect()))
    finally:
        spark.conf.unset("spark.raceflow.hotRows")
    _alike(got, want)


def test_outcomes_are_read_packed_and_plain(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("race_id"), F.lit(1).alias("runner"), F.lit(0.5).alias("win"))
    stored = outcomes.outcome_rows(rows, {"win": "win"}, "v1", F.lit("2024-01-01"))
    stored.filter("race_id < '3'").write.mode("append").json(str(tmp_path / "o"), compression="gzip")
    stored.filter("race_id >= '3'").write.mode("append").json(str(tmp_path / "o"))
    assert files.read_outcomes(spark, str(tmp_path / "o")).count() == 6


def test_outcomes_of_every_race_become_documents(spark, tmp_path):
    lines = [(race, 10 * race + line, 1, line, 1.0 + line) for race in (1, 2, 17, 305) for line in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    for floor in ("1000", "2"):  # without and with hot races
        spark.conf.set("spark.raceflow.hotRows", floor)
        try:
            rows = files_catalog.outcome_documents(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.raceflow.hotRows")
        assert sorted((r["race_id"], r["key"], r["market"], r["entries"]) for r in rows) == sorted(
            (str(race), str(key), market, 3) for race in (1, 2, 17, 305) for key in (1, 2, 3) for market in ("win", "place"))


def test_latest_rows_join_only_keys_that_are_behind(spark):
    rows = [(1, 1, "t1", "a"), (1, 1, "t2", "b"), (1, 1, "t2", "b"), (2, 1, "t1", "c"), (2, 1, "t0", "d"), (3, None, "t2", "e"), (4, 1, None, "f")]
    df = spark.createDataFrame(rows, "race int, model int, t string, v string")
    plan = files.latest_rows(df.filter("race = 1"), ["race", "model"], "t")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["v"] for r in files.latest_rows(df, ["race", "model"], "t").collect()) == ["b", "b", "c"]


def test_likelihood_sums_are_not_shuffled(spark, monkeypatch):
    rows = [(g, ((g * 37 + i * 11) % 23 - 11) / 4.0) for g in range(40) for i in range(2 + g % 9)] + [(None, 1.5), (3, None)]
    df = spark.createDataFrame(rows, "g int, z double")
    monkeypatch.setattr(learning, "SUM_BYTES", 10 * 1000)
    cold, warm = (learning.student_t_df(df, "g", "z", hot=hot) for hot in ([], [(3,), (8,), (None,)]))
    plan = cold._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # that of the rows; the sums stay where they are made
    want = {}
    for g in {g for g, _ in rows}:
        z = [v for h, v in rows if h == g and v is not None]
        grid = [round(2.1 + i * 0.25, 6) for i in range(112)]
        fits = [len(z) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi))
                - (nu + 1) / 2 * sum(math.log1p(v * v / nu) for v in z) for nu in grid]
        want[g] = (len(z), 5.0 if len(z) < 3 else grid[fits.index(max(fits))])
    for df in (cold, warm):
        assert {r["g"]: (r["n"], r["nu"]) for r in df.collect()} == want


def test_lines_of_descent_are_written_once(spark, monkeypatch):
    written, store = [], pedigree.cut_lineage

    def counted(df):
        out = store(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(pedigree, "cut_lineage", counted)
    parentage = spark.range(1, 41).selectExpr("id AS entity", "explode(array(id - 1, id - 2)) AS parent").filter("parent >= 0")
    found = pedigree.ancestors(parentage, "entity", "parent", depth=16)
    assert found.count() <= sum(written) <= 1.3 * found.count()  # beyond ``depth`` nothing is made


def test_orders_come_by_field_size(spark):
    rows = spark.createDataFrame([(1, r, 0.4 / r) for r in range(1, 6)] + [(2, r, 0.5 / r) for r in (1, 2)], "race_id int, runner int, win double")
    out = outcomes.top_orders(rows, top=20, length=3)
    assert "array_max" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert {r["race_id"] for r in got} == {1} and len(got) == 20
    assert [list(r["runners"]) for r in sorted(got, key=lambda r: r["place"])][0] == [1, 2, 3]


def test_rolling_values_are_lags_worked_out_by_the_batch(spark):
    values = [3.0, None, 1.5, float("nan"), 8.0, 2.0, 2.0, None]
    rows = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate(values)], "k int, i int, v double")
    out = timeline.with_history(rows, ["k"], ["i"], timeline.rolling(["v"], [1, 3, 5], list(timeline._OF_VALUES)), hot=[])
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    for row in out.collect():
        for w in (1, 3, 5):
            seen = [v for v in values[max(row["i"] - w, 0):row["i"]] if v is not None and v == v]
            want = {"mean": statistics.fmean, "median": statistics.median, "max": max, "min": min, "sum": sum}
            want = {a: f(seen) if seen else None for a, f in want.items()}
            want |= {"std": statistics.stdev(seen) if len(seen) > 1 else None, "count": len(seen)}
            got = {a: row[f"past_{w}_v_{a}"] for a in want}
            assert got == {a: None if x is None else pytest.approx(x) for a, x in want.items()}


def test_statistics_are_looked_up_by_narrow_rows(spark, sf, monkeypatch):
    """Without broadcasts no lookup moves the wide rows, which are joined by their number alone."""
    widths, look = [], skew.lookup

    def seen(df, *args, **kw):
        widths.append(len(df.columns))
        return look(df, *args, **kw)

    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "lookup", seen)
    df = entrants(spark, sf, learning_catalog._RAW).filter("race_id % 40 = 0")
    hot = {k: [] for k in ("horse_id", "race_id", "jockey_id")}
    out = features.build(F.col("race_date") >= "1998-01-01", df.unionByName(df), KEY, TIMELINE, hot=hot)
    assert len(out.columns) > 150 and len(widths) >= 12 and max(widths) <= 6
    assert out.count() == 2 * df.filter("race_date >= '1998-01-01'").count()  # rows that come twice stay twice


def test_medians_are_found_in_the_families(spark, monkeypatch):
    """No wide row is moved or stored for the values that fill the table."""
    rows = spark.range(240).selectExpr(
        "id div 6 AS race_id", "id * 7 % 23 AS horse_id", "id % 5 AS jockey_id", "CAST(id % 6 + 1 AS INT) AS bracket_number",
        "date_add(DATE '1999-01-01', CAST(id div 6 AS INT) * 20) AS race_date", "id * 11 % 6 + 1 AS finish_position", "CAST(id * 11 % 6 = 0 AS INT) AS is_win",
        "CASE WHEN id % 4 > 0 THEN id * 13 % 17 / 2.0D END AS morning_odds", "50 + id % 9 AS basis_weight", "CASE WHEN id % 7 > 0 THEN 'A' ELSE 'N' END AS track_surface")
    recipe = {"basic_features": features.DEFAULT_RECIPE["basic_features"], "career_stats": ["career_starts", "career_wins", "career_win_rate"],
              "past_performance": {"columns": ["finish_position"], "windows": [1, 3], "aggregations": ["mean", "std"]},
              "entity_stats": [{"id_column": "jockey_id", "target": "is_win", "agg": "mean", "feature_name": "jockey_win_rate"}],
              "z_score": ["basis_weight", "career_win_rate"], "relative": True, "trend_windows": [3]}
    hot = {k: [] for k in ("horse_id", "race_id", "jockey_id")}
    for limit in (skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        table, parts = features.families(F.col("race_date") >= "2000-01-01", rows, KEY, TIMELINE, recipe, hot=hot)
        want = sorted(features.imputed(table, [*KEY, "race_date"], recipe).collect())
        made, whole = parts(), skew.assembled
        monkeypatch.setattr(skew, "assembled", None)
        out = features.imputed(table, [*KEY, "race_date"], recipe, parts=made)
        monkeypatch.setattr(skew, "assembled", whole)
        assert len(made) > 2 and max(len(p.columns) for p in made) < len(table.columns)
        assert sorted(out.collect()) == want and len(want) == 126
        assert not any(x is None for row in want for x in row)


def _measured(spark):
    df = spark.range(4000).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id * 31 % 11 AS DOUBLE) / 2 AS b", "0.0D AS c", "CAST(id % 5 AS INT) AS fold")
    df = df.withColumn("y", F.col("a") * F.col("a") + 3 * F.col("b") + F.pmod(F.hash("id"), F.lit(100)) / 50)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).coalesce(1)


def test_trees_are_fitted_on_sums_of_rows(spark):
    df = _measured(spark)
    ours = learning.BoostedTrees(labelCol="y", maxIter=5, maxDepth=3, seed=1)
    edges = learning.bin_edges(df, "features")
    assert [len(e) for e in edges] == [6, 10, 0]
    sums = ours.summed(df, edges)
    assert sums.count() == 77 and sums.agg(F.sum("_rows")).first()[0] == 4000
    model = ours.fit(df)
    rows = GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1, predictionCol="rows").fit(df)  # every value is a bin of its own there too
    both = rows.transform(model.transform(df))
    assert all(math.isclose(r["prediction"], r["rows"], rel_tol=1e-9) for r in both.collect())
    assert model.featureImportances.toArray() == pytest.approx(rows.featureImportances.toArray())


def test_rare_and_many_values_have_bins(spark):
    df = spark.range(9000).selectExpr("CAST(id = 17 AS DOUBLE) AS a", "id * 1.0D AS b")
    rare, many = learning.bin_edges(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df), "features")
    assert rare == [1.0] and len(many) == 31
    assert all(abs(e - 9000 * j / 32) < 30 for j, e in enumerate(many, 1))


def test_stacked_trees_sum_up_the_rows_once(spark, monkeypatch):
    calls, summed = [], learning.BoostedTrees.summed

    def seen(self, *args):
        calls.append(args)
        return summed(self, *args)

    monkeypatch.setattr(learning.BoostedTrees, "summed", seen)
    df = _measured(spark)
    learners = {"linear": LinearRegression(labelCol="y"), "trees": learning.BoostedTrees(labelCol="y", maxIter=3, maxDepth=3, seed=1)}
    out, _, refitted = learning.stacked(df, "y", learners)
    assert len(calls) == 1 and out.count() == 4000 and set(refitted) == {"linear", "trees"}
    got = {r["id"]: r["trees"] for r in out.select("id", "trees").collect()}
    for k in (0, 3):  # fitted without the fold's own rows
        alone = learning.BoostedTrees(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(df.filter(F.col("fold") != k))
        assert all(math.isclose(got[r["id"]], r["prediction"], rel_tol=1e-9) for r in alone.transform(df.filter(F.col("fold") == k)).collect())
