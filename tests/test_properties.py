"""Properties that hold whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceflow.bindings import KEY, TIMELINE, entrants
from raceflow.operators import metrics, outcomes, selection, staking, timeline
from raceflow.plans import learning

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_no_feature_depends_on_later_rows(spark):
    rows = entrants(spark, SMALL, [*KEY, "race_date", "is_win", "finish_time_seconds"]).dropDuplicates(KEY)
    spec = (timeline.start_count(), timeline.prior_sum("wins", F.col("is_win")),
            timeline.rolling(["finish_time_seconds"], [3], ["mean", "max"]))
    early = rows.filter("race_date < '1998-01-01'")
    whole = timeline.with_history(rows, ["horse_id"], TIMELINE, *spec, hot=[]).filter("race_date < '1998-01-01'")
    alone = timeline.with_history(early, ["horse_id"], TIMELINE, *spec, hot=[])
    assert rows_of(whole) == rows_of(alone)


def test_entity_windows_share_one_sort_and_no_python(spark):
    rows = entrants(spark, SMALL, [*KEY, "race_date", "is_win"])
    out = timeline.with_history(rows, ["horse_id"], TIMELINE, timeline.start_count(),
                                timeline.prior_sum("wins", F.col("is_win")), timeline.days_since_previous("race_date"), hot=[])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(horse_id") == 1 and "Python" not in plan


def test_date_filter_reaches_the_scan(spark):
    from raceflow.sources.files import read_by_date
    plan = read_by_date(spark, f"{SMALL}/orders.parquet", "1997-01-01", "1997-02-01", "o_orderdate").select(
        "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_features_do_not_see_the_race_itself(spark):
    """Other results of the target day leave its features as they are, and no result column is among them."""
    from raceflow.catalog.learning import _RAW
    from raceflow.plans import features
    from raceflow.session import cut_lineage
    rows = cut_lineage(entrants(spark, SMALL, _RAW).dropDuplicates(KEY))
    last = rows.agg(F.max("race_date")).first()[0]
    target = F.col("race_date") == last
    other = rows
    for c in features.RESULT_COLUMNS:
        if c in rows.columns:
            kind = rows.schema[c].dataType
            other = other.withColumn(c, F.when(target, (F.col(c).cast("double") * 3 + 5).cast(kind)).otherwise(F.col(c)))
    plain, changed = (features.build(target, df, KEY, TIMELINE, hot={k: [] for k in ("horse_id", "race_id", "jockey_id")})
                      for df in (rows, other))
    assert len(plain.columns) > 150 and not set(plain.columns) & set(features.RESULT_COLUMNS)
    got = rows_of(plain)
    assert got and got == rows_of(changed)
    entries = rows.filter(target)  # a table of their own, still with results in it
    assert rows_of(features.build(entries, rows, KEY, TIMELINE).select(plain.columns)) == got
    ahead = features.build(entries, rows.filter(~target), KEY, TIMELINE)  # not run yet
    assert rows_of(ahead.select(plain.columns)) == got


def test_strictly_earlier_statistics(spark):
    from raceflow.catalog.learning import _RAW
    from raceflow.plans import features
    from raceflow.session import cut_lineage
    rows = cut_lineage(entrants(spark, SMALL, _RAW).dropDuplicates(KEY))
    recipe = {k: features.DEFAULT_RECIPE[k] for k in ("entity_stats", "interaction_features", "course", "exclude_patterns")}
    out = cut_lineage(features.build(F.col("race_date") >= "1998-01-01", rows, KEY, TIMELINE, recipe, as_of="row"))
    assert {"jockey_win_rate", "jockey_own_venue_win_rate", "nicks_avg_finish", "combo_races"} <= set(out.columns)
    one = out.orderBy(F.desc("race_date"), *KEY).first()
    before = rows.filter((F.col("jockey_id") == one["jockey_id"]) & (F.col("race_date") < one["race_date"]))
    assert one["jockey_win_rate"] == pytest.approx(before.agg(F.avg("is_win")).first()[0])


def test_wide_context_is_an_error_but_has_rows(spark, monkeypatch):
    from raceflow.operators import stats
    from raceflow.plans import learning
    monkeypatch.setattr(stats, "MAX_CONTEXTS", 3)
    df = spark.createDataFrame([(1, f"c{i}", float(i)) for i in range(5)], "id int, c string, x double")
    recipe = {"id_column": "id", "context_column": "c", "target": "x", "agg": "mean", "feature_template": "id_{context}"}
    with pytest.raises(ValueError, match="c has more than 3 values"):
        stats.interaction_statistics(df, [recipe])
    with pytest.raises(ValueError, match="c has more than 3 values"):
        learning.one_hot(df, "c", "c")
    assert [r["feature"] for r in learning.one_hot_rows(df, ["id"], {"c": "c"}).orderBy("feature").collect()] == [f"c_c{i}" for i in range(5)]
    assert stats.interaction_rows(df, [recipe]).count() == 5
    listed = stats.interaction_statistics(df, [{**recipe, "values": ["c1", "c4"]}])["id"].first()
    assert (listed["id_c1"], listed["id_c4"]) == (1.0, 4.0)


def test_table_goes_on_after_a_restart(spark):
    from raceflow.session import scratch_path
    from raceflow.streaming.incremental import VersionedTable, upsert_batch

    def rows(*data):
        return spark.createDataFrame(list(data), "k int, v string")

    place = scratch_path(spark, "restart")
    upsert_batch(VersionedTable(spark, place, ["k"], 3))(rows((1, "a"), (2, "a"), (3, "a")), 0)
    again = VersionedTable(spark, place, ["k"], 3)
    upsert_batch(again)(rows((2, "b"), (4, "b")), 1)
    upsert_batch(again)(rows((2, "replayed")), 1)
    rows((9, "never committed")).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{place}/data/version=3")
    last = VersionedTable(spark, place, ["k"], 3)
    assert sorted((r["k"], r["v"]) for r in last.read().collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    upsert_batch(last)(rows(), 7)
    assert VersionedTable(spark, scratch_path(spark, "new"), ["k"]).read() is None


def test_large_race_keeps_every_runner(spark):
    """The stored shape of outcomes does not depend on the size of the race."""
    from raceflow.sources.files import latest_rows
    probabilities = spark.createDataFrame([("big", i, 1 / 400) for i in range(400)] + [("small", 1, 1.0)],
                                          "race_id string, runner int, win double")
    old, new = (outcomes.outcome_rows(probabilities, {"win": "win"}, "m", F.lit(t)) for t in ("t1", "t2"))
    newest = latest_rows(old.unionByName(new), ["race_id", "model_id"], "created_ts")
    assert newest.count() == 401 and newest.select("created_ts").distinct().count() == 1
    docs = outcomes.pack(newest, "race_id", "key", "probability", "p", parts=5)
    assert outcomes.unpack(docs, "race_id", "p").groupBy("race_id").count().orderBy("race_id").collect() == [("big", 400), ("small", 1)]


def test_student_t_recovers_degrees_of_freedom(spark):
    z = np.random.default_rng(42).standard_t(10, 4000)
    df = spark.createDataFrame([("g", float(v)) for v in z] + [("few", 0.1)], "g string, z double")
    nu = {r["g"]: r["nu"] for r in learning.student_t_df(df, "g", "z").collect()}
    assert 8 < nu["g"] < 12 and nu["few"] == 5.0


def test_sigma_is_positive(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.0,), (None,)], "v double")
    got = [r[0] for r in df.select(learning.sigma_from_variance(F.col("v"), F.lit(1.5))).collect()]
    assert got == [1.5, 1.5, 2.0, 1.5]


def test_kelly(spark):
    df = spark.createDataFrame([(0.5, 3.0), (0.1, 3.0), (1.0, 2.0), (0.9, 1.0)], "p double, o double")
    rows = df.select(staking.kelly_fraction(F.col("p"), F.col("o")), staking.kelly_growth(F.col("p"), F.col("o"))).collect()
    assert rows[0][0] == pytest.approx(0.25) and rows[0][1] == pytest.approx(0.5 * math.log(1.5) + 0.5 * math.log(0.75))
    assert rows[1][0] == 0.0 and rows[1][1] is None
    assert rows[2][0] == 1.0 and rows[2][1] == pytest.approx(math.log(2))
    assert rows[3][0] is None


def test_no_race_worth_a_budget(spark):
    scores = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "race_id string, score double")
    assert [r["budget"] for r in staking.proportional_budget(scores, 1000).collect()] == [0.0, 0.0]


def test_calibration_error_last_bin_closed(spark):
    df = spark.createDataFrame([(1.0, 1), (0.95, 0), (0.05, 0)], "p double, y int")
    assert metrics.calibration_error(df, "p", "y").first()[0] == pytest.approx(2 / 3 * 0.475 + 1 / 3 * 0.05)


def test_leakage_is_rejected(spark):
    df = spark.range(1).withColumn("win_odds", F.lit(2.0))
    assert selection.without_leakage(df, ["win_odds"]).columns == ["id"]
    with pytest.raises(selection.LeakageError):
        selection.without_leakage(df, ["win_odds"], reject=True)
