"""Stored sketches against exact profiles."""

import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from raceflow.operators import sketches

SCHEMA = "day string, id long, kind string, value double"


def rows(days):
    draw = random.Random(11)
    out = []
    for day in range(days):
        for i in range(250):
            value = draw.choice([None, 0.0, -draw.lognormvariate(2, 2), draw.lognormvariate(2, 2), draw.lognormvariate(0, 1), 5.0])
            out.append((f"d{day:03}", draw.randrange(15_000), draw.choice(["a", "b", None]), value))
    return out + [("d000", 1, "a", float("nan")), ("d000", 1, "a", float("inf"))]


def exact(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


@pytest.fixture(scope="module")
def stored(spark):
    data, path = rows(90), tempfile.mkdtemp(prefix="sketches-", dir="/tmp")
    df = spark.createDataFrame(data, SCHEMA)
    sketches.store(sketches.sketch(df, "day", ["id", "kind", "value"]), path)
    return data, df, path


def test_ninety_days_within_the_stated_error(spark, stored):
    data, _, path = stored
    got = {r["column"]: r for r in sketches.profile(sketches.stored(spark, path), [0.01, 0.25, 0.5, 0.99]).collect()}
    assert {c: r["rows"] for c, r in got.items()} == dict.fromkeys(["id", "kind", "value"], len(data))
    for at, c in ((1, "id"), (2, "kind"), (3, "value")):
        assert got[c]["nulls"] == sum(r[at] is None for r in data)
        n = len({r[at] for r in data if r[at] is not None})
        assert got[c]["distinct"] == pytest.approx(n, rel=3 * 0.016)
    numbers = [r[3] for r in data if r[3] is not None and math.isfinite(r[3])]
    mean = sum(numbers) / len(numbers)
    spread = math.sqrt(sum((v - mean) ** 2 for v in numbers) / (len(numbers) - 1))
    assert got["value"]["mean"] == pytest.approx(mean) and got["value"]["deviation"] == pytest.approx(spread)
    assert (got["value"]["low"], got["value"]["high"]) == (min(numbers), max(numbers))
    for p, name in ((0.01, "p1"), (0.25, "p25"), (0.5, "p50"), (0.99, "p99")):
        assert got["value"][name] == pytest.approx(exact(numbers, p), rel=0.0100001, abs=1e-12)
        assert got["id"][name] == pytest.approx(exact([r[1] for r in data], p), rel=0.0100001)
    assert got["kind"]["mean"] is None


def test_a_day_is_added_alone(spark, stored):
    data, df, path = stored
    before = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(path) for f in [os.path.join(d, x) for x in fs] if "of=" in f}
    new = df.filter("day = 'd007'").withColumn("value", F.col("value") * 2)
    sketches.store(sketches.sketch(new, "day", ["id", "kind", "value"]), path)
    after = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(path) for f in [os.path.join(d, x) for x in fs] if "of=" in f}
    assert {f.split("of=")[1][:4] for f, _ in set(before.items()) ^ set(after.items())} == {"d007"}
    one = sketches.stored(spark, path).filter("of = 'd007'")
    read = [r[0] for r in one.select(F.input_file_name()).distinct().collect()]
    assert read and all("of=d007" in f for f in read)
    whole = sketches.merged(sketches.sketch(df.filter("day <> 'd007'").unionByName(new).withColumn("day", F.lit("x")), "day", ["id", "value"]))
    parts = sketches.merged(sketches.stored(spark, path).filter("column <> 'kind'"))
    exactly = ["column", "part", "slot", "rows", "least", "low", "high"]
    assert sorted(map(str, whole.select(exactly).collect())) == sorted(map(str, parts.select(exactly).collect()))


@pytest.mark.parametrize("n", [0, 1, 3, 700, 4096, 60_000])
def test_distinct_at_every_size(spark, n):
    df = spark.range(n).select(F.lit("d").alias("day"), "id").union(spark.range(n).select(F.lit("d"), "id"))
    got = sketches.profile(sketches.sketch(df, "day", ["id"])).collect()
    assert [r["rows"] for r in got] == ([2 * n] if n else [])
    assert all(r["distinct"] == pytest.approx(n, rel=0.05) for r in got)


def test_overlap(spark):
    days = spark.range(30_000).select(F.explode(F.expr(
        "filter(array(if(id < 20000, 'a', null), if(id >= 10000, 'b', null)), x -> x is not null)")).alias("day"), "id")
    sk = sketches.sketch(days, "day", ["id"])
    a, b = sk.filter("period = 'a'"), sk.filter("period = 'b'")
    assert sketches.overlap(a, b).collect()[0]["overlap"] == pytest.approx(1 / 3, abs=0.03)
    assert sketches.overlap(a, a).collect()[0]["overlap"] == 1.0
    assert sketches.overlap(a.limit(0), b.limit(0)).collect() == []


def test_buckets_keep_the_order(spark):
    values = sorted([0.0, 1.0, -1.0, 1e-300, -1e-300, 1e300, -1e300, 3.5, -3.5, 0.02])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", sketches.bucket(F.col("v")).alias("b"))
    got = df.select("v", "b", sketches.middle(F.col("b")).alias("m")).orderBy("v").collect()
    assert [r.b for r in got] == sorted(r.b for r in got)
    assert all(r.m == pytest.approx(r.v, rel=0.0100001) for r in got)
