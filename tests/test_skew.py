"""The distributed path for hot keys gives what the plain path gives."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.operators import metrics, timeline


@pytest.fixture(scope="module")
def rows(spark):
    """One entity holds a third of the rows; values have ties and NULLs."""
    rng = random.Random(7)
    data = []
    for i in range(900):
        who = "hot" if i % 3 == 0 else f"e{rng.randrange(40)}"
        data.append((who, rng.randrange(60), i, rng.choice([None, 1, 2, 3, 5, 8]), rng.randrange(4)))
    return spark.createDataFrame(data, "who string, day int, id int, x int, j int").cache()


def table(df):
    return sorted(tuple(r) for r in df.collect())


HOT = [("hot",)]
ORDER = ["day", "id"]


def test_hot_keys_are_found(spark, rows):
    assert skew.hot_keys(rows, ["who"], 100) == HOT


@pytest.mark.parametrize("hot", [HOT, skew.EVERYTHING])
def test_history(rows, hot):
    spec = (timeline.start_count(), timeline.prior_sum("total", F.col("x")), timeline.previous(["j"]),
            timeline.rolling(["x"], [1, 3, 10], ["mean", "max", "std", "median", "count"]))
    plain = timeline.with_history(rows, ["who"], ORDER, *spec, hot=[])
    assert table(plain.na.fill(-1)) == table(timeline.with_history(rows, ["who"], ORDER, *spec, hot=hot).na.fill(-1))


@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("ascending", [True, False])
def test_rank(rows, method, ascending):
    a = skew.rank_within(rows, ["who"], "x", "r", ascending, method, hot=[])
    b = skew.rank_within(rows, ["who"], "x", "r", ascending, method, hot=HOT)
    assert table(a.na.fill(-1)) == table(b.na.fill(-1))


def test_row_numbers_and_group_aggregates(rows):
    assert table(skew.row_numbers(rows, ["who"], ORDER, "r", []).drop("x")) == table(
        skew.row_numbers(rows, ["who"], ORDER, "r", HOT).drop("x"))
    aggs = {"n": F.count(F.lit(1)), "hi": F.max("id")}
    assert table(skew.over_group(rows, ["who"], aggs, []).drop("x")) == table(
        skew.over_group(rows, ["who"], aggs, HOT).drop("x"))


def test_lookup_beyond_broadcast(rows, monkeypatch):
    stats = rows.groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    want = table(skew.lookup(rows, stats, ["who"]).drop("x"))
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    assert table(skew.lookup(rows, stats, ["who"], hot=HOT).drop("x")) == want
    assert table(skew.lookup(rows, stats, ["who"], hot=[], null_matches=True).drop("x")) == want


def test_global_running_sum_in_chunks(rows):
    out = skew.history(rows, [], ORDER, totals={"before": F.lit(1)}, hot=skew.EVERYTHING)
    got = [r["before"] for r in out.orderBy(*ORDER).collect()]
    assert got == list(range(900))


def test_quantiles_of_many_columns(spark):
    """Against numpy; the number of jobs does not grow with the columns."""
    import numpy as np
    rng = random.Random(3)
    data = [(rng.choice([rng.gauss(0, 50), 7.0]), rng.randrange(5), None, rng.choice([None, float("nan"), 1.5])) for _ in range(3000)]
    df = spark.createDataFrame(data, "v double, k int, empty double, some double")
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = skew.column_quantiles(df, dict.fromkeys(df.columns, probs))
    for c, i in (("v", 0), ("k", 1)):
        assert got[c] == pytest.approx(list(np.quantile([r[i] for r in data], probs)))
    assert got["empty"] == [None] * 5 and got["some"] == [1.5] * 5
    assert skew.exact_quantiles(df, "k", [0.5]) == [got["k"][2]]

    def jobs(columns):
        group = f"quantiles-{len(columns)}"
        spark.sparkContext.setJobGroup(group, "")
        skew.exact_medians(df, columns)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(["v", "k", "some"]) <= jobs(["v"]) + 1


def test_chained_measures_split_once(rows):
    """Four chained in-group measures read their input once for the cold and once for the hot part."""
    def chained(part, hot):
        part = skew.over_group(part, ["who"], {"n": F.count(F.lit(1))}, hot)
        part = skew.row_numbers(part, ["who"], ORDER, "r", hot)
        part = skew.rank_within(part, ["who"], "x", "k", hot=hot)
        return skew.over_group(part, ["who"], {"hi": F.max("id")}, hot)

    stored = skew.cut_lineage(rows)
    out = skew.by_part(stored, ["who"], HOT, chained)
    assert table(out.na.fill(-1)) == table(skew.by_part(rows, ["who"], [], chained).na.fill(-1))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "day#" in line and "_chunk" not in line and ",n#" not in line]
    assert len(scans) <= 2


def test_spearman(spark, rows):
    df = rows.withColumn("y", F.col("id") % 7)
    a = metrics.spearman(df, ["who"], "x", "y", hot=[])
    b = metrics.spearman(df, ["who"], "x", "y", hot=HOT)
    assert table(a.select("who", F.round("correlation", 9))) == table(b.select("who", F.round("correlation", 9)))


def test_quantiles_of_a_table_in_parts(spark):
    df = spark.range(200).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id * 7 % 31 END AS a", "CAST(id % 3 AS DOUBLE) AS b", "CAST(NULL AS INT) AS c")
    columns = {"a": [0.1, 0.5], "b": [0.5], "c": [0.5]}
    got = skew.part_quantiles([df.select("id", "b"), df.select("id", "a", "b"), df.select("c")], columns)
    assert got == skew.column_quantiles(df, columns) and got["c"] == [None]
    with pytest.raises(ValueError, match="'a'"):
        skew.part_quantiles([df.select("b")], {"a": [0.5], "b": [0.5]})
