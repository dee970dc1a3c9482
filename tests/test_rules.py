"""Literal cases of the text rules."""

import datetime

import pytest
from pyspark.sql import functions as F

from raceflow.functions import bands, text


def cases(spark, rule, pairs):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(pairs)], "i int, s string")
    out = rule(F.col("s"))
    out = F.struct(*out) if isinstance(out, (tuple, list)) else out
    got = [r["v"] for r in df.select("i", out.alias("v")).orderBy("i").collect()]
    return [tuple(v) if hasattr(v, "asDict") else v for v in got], [w for _, w in pairs]


@pytest.mark.parametrize("rule,pairs", [
    (text.int_or_null, [("16頭", 16), ("---", None), ("", None), ("0", None), ("-5", 5), ("1.5", 15), (None, None)]),
    (text.float_or_null, [("54.0", 54.0), ("---.-", None), ("0", None), ("1.2.3", None), (".", None), ("54kg", 54.0)]),
    (text.sex_and_age, [("牡3", ("牡", 3)), ("", (None, None)), ("牝", ("牝", None))]),
    (text.time_to_seconds, [("1:59.8", 119.8), ("59.8", 59.8), ("---", None), ("1:00.25", 62.5), ("x1:59.8", None)]),
    (text.margin_to_seconds, [("1.1/2", 0.3), ("3/4", 0.15), ("5", 1.0), ("ハナ", 0.02), ("大", 5.0), ("x", None),
                              ("1/0", None), ("同着", 0.0), ("", None)]),
    (text.weight_and_change, [("478(+2)", (478, 2)), ("450(-5)", (450, -5)), ("478", (478, None)), ("---", (None, None))]),
    (text.prize, [("1,348.6", 1349), ("---.-", None), ("2.5", 2), ("3.5", 4), ("x", None)]),
    (text.name, [(" A ", "A"), ("---.-", None), ("編集", None), ("", None)]),
    (text.plain_odds, [("2.5", 2.5), ("---", None), ("1,000.5", 1000.5), ("-1", -1.0)]),
    (text.ancestor_id, [("000", None), ("0000", None), ("000a00033a", "000a00033a"), ("abc", None), ("a-b_c d", "abcd")]),
    (text.distance_surface_condition, [("芝1600", (1600, "芝", None)), ("ダ1800良", (1800, "ダート", "良")),
                                       ("1600", (1600, None, None)), ("障3000", (None, None, None))]),
    (text.meeting, [("1回中山2日目", (1, "中山", 2)), ("中山", (None, None, None))]),
    (text.race_class, [("天皇賞(GI)", "G1"), ("京成杯(GIII)", "G3"), ("目黒(GII)", "G2"), ("2歳未勝利", "未勝利"), ("x", None)]),
    (text.age_limit, [("3歳以上500万下", "3歳以上"), ("3歳新馬", "3歳"), ("2歳未勝利", "2歳")]),
    (text.corners, [("6-6-5-4", (6, 6, 5, 4)), ("1-(2)", (1, 2, None, None)), ("", (None,) * 4)]),
    (text.iso_date, [("2020年7月25日", datetime.date(2020, 7, 25)), ("2023/06/01", datetime.date(2023, 6, 1)),
                     ("2023-02-30", None), ("none", None)]),
    (text.to_half_width, [("２０２４／０１", "2024/01"), ("Ａｂ　ｃ", "Ab c")]),
    (text.race_number, [("202001010112", 12), ("20xx", None)]),
])
def test_text_rule(spark, rule, pairs):
    got, want = cases(spark, rule, pairs)
    assert got == want


def test_running_style(spark):
    got, want = cases(spark, lambda t: bands.running_style(text.first_corner(t)), [
        ("1-1-1-1", "nige"), ("4-5", "senko"), ("10-9", "sashi"), ("11-1", "oikomi"), (None, "unknown"), ("x-1", "unknown")])
    assert got == want


def test_distance_band_edges(spark):
    df = spark.createDataFrame([(1400,), (1401,), (4000,), (4001,), (None,)], "d int")
    rows = df.select(bands.distance_half_open(F.col("d")), bands.distance_right_closed(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [("mile", "sprint"), ("mile", "mile"), ("marathon", "extreme_long"),
                                        ("marathon", None), ("unknown", None)]


def test_log_line(spark):
    df = spark.createDataFrame([("2025-11-18 09:02:52,233 - __main__ - INFO - started - now",), ("noise",)], "s string")
    rows = [r[0] for r in df.select(text.log_line(F.col("s"))).collect()]
    assert (rows[0]["module"], rows[0]["level"], rows[0]["message"]) == ("__main__", "INFO", "started - now")
    assert rows[0]["logged_at"].microsecond == 233000 and rows[1] is None


def test_compatibility_form(spark):
    """Every assigned code point, alone and between letters and accents."""
    import unicodedata
    points = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    rows = [(i, f"a{c}\u0301e\u0323") for i, c in enumerate(points)] + [(-1, None), (-2, ""), (-3, "ﾊﾟ㋀ﬁ①각")]
    out = spark.createDataFrame(rows, "i int, s string").repartition(4).select("i", text.compatibility_form(F.col("s")).alias("v"))
    got = {r["i"]: r["v"] for r in out.collect()}
    assert got[-1] is None and got[-2] == "" and got[-3] == "パ1月fi1각"
    assert [i for i, c in enumerate(points) if got[i] != unicodedata.normalize("NFKC", rows[i][1])] == []
