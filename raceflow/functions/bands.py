"""Bands, classes and measures derived from the columns of one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the distance and field-size bands.
HALF_OPEN_DISTANCE = [(1400, "sprint"), (1800, "mile"), (2200, "intermediate"), (2800, "long")]
CLOSED_DISTANCE = [(1400, "sprint"), (1800, "mile"), (2200, "intermediate"), (3000, "long"), (4000, "extreme_long")]
FIELD_SIZE = [(10, "small"), (14, "medium"), (18, "large"), (24, "extra_large")]
SEASONS = {"winter": [12, 1, 2], "spring": [3, 4, 5], "summer": [6, 7, 8], "autumn": [9, 10, 11]}
REGIONAL_VENUES = ["園田", "姫路", "高知", "佐賀", "大井", "川崎", "浦和", "船橋",
                   "盛岡", "水沢", "金沢", "笠松", "名古屋", "門別", "帯広"]

REGIONAL_PRIZE_SCALE = 0.3
REGIONAL_MAIDEN = ("未勝利", "地方未勝利")


def right_closed(x: Column, bounds: Sequence[tuple[float, str]], low: float = 0) -> Column:
    """Label of the band (previous bound, bound] holding ``x``; NULL outside."""
    out = F.lit(None).cast("string")
    for upper, label in reversed(bounds):
        out = F.when(x <= upper, label).otherwise(out)
    return F.when(x > low, out)


def distance_half_open(metres: Column, last: str = "marathon") -> Column:
    """Bands [.., bound), ``unknown`` for NULL."""
    out = F.lit(last)
    for upper, label in reversed(HALF_OPEN_DISTANCE):
        out = F.when(metres < upper, label).otherwise(out)
    return F.when(metres.isNull(), "unknown").otherwise(out)


def distance_right_closed(metres: Column) -> Column:
    return right_closed(metres, CLOSED_DISTANCE)


def field_size(head_count: Column) -> Column:
    return right_closed(head_count, FIELD_SIZE)


def season(month: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, months in SEASONS.items():
        out = F.when(month.isin(months), label).otherwise(out)
    return out


def importance(prize: Column) -> Column:
    """By prize, a missing one counting as 500."""
    known = F.coalesce(prize, F.lit(500))
    return F.when(known >= 2000, "high").when(known >= 1000, "medium").otherwise("low")


def running_style(first_corner: Column) -> Column:
    return (F.when(first_corner.isNull(), "unknown").when(first_corner == 1, "nige")
            .when(first_corner <= 4, "senko").when(first_corner <= 10, "sashi").otherwise("oikomi"))


def membership(value: Column, groups: Mapping[str, Sequence]) -> dict[str, Column]:
    """0/1 flag per named group of values; NULL belongs to none."""
    return {name: F.coalesce(value.isin(list(members)), F.lit(False)).cast("int")
            for name, members in groups.items()}


def regional(venue: Column, race_class: Column, venues: Sequence[str] = tuple(REGIONAL_VENUES)) -> dict[str, Column]:
    """is_regional, the prize scale of regional races, and the maiden class renamed there."""
    is_regional = F.coalesce(venue.isin(list(venues)), F.lit(False))
    return {"is_regional": is_regional, "prize_scale_factor": F.when(is_regional, F.lit(REGIONAL_PRIZE_SCALE)),
            "race_class": F.when(is_regional & (race_class == REGIONAL_MAIDEN[0]), REGIONAL_MAIDEN[1]).otherwise(race_class)}


def implied_probability(odds: Column) -> Column:
    return F.lit(1.0) / (odds + 1)


def pace_index(before_last: Column, last_3f: Column) -> Column:
    return F.try_divide(before_last, last_3f + 0.1)


def expected_value(probability: Column, odds: Column) -> Column:
    return probability * odds


def break_even(odds: Column) -> Column:
    """Probability at which a bet returns its stake."""
    return F.try_divide(F.lit(1.0), odds)


def null_count(columns: Sequence[str]) -> Column:
    """Number of NULL columns in the row."""
    out = F.lit(0)
    for c in columns:
        out = out + F.col(c).isNull().cast("int")
    return out


def is_stale(last_seen: Column, as_of: Column, ttl_days: int) -> Column:
    """Never seen, or seen more than ``ttl_days`` before ``as_of``."""
    return last_seen.isNull() | (F.datediff(as_of, last_seen) > ttl_days)


def date_spans(start: Column, end: Column, days: int) -> Column:
    """[start, end] cut into consecutive spans of ``days`` days (array of structs)."""
    starts = F.sequence(start, end, F.expr(f"interval {int(days)} days"))
    return F.transform(starts, lambda s: F.struct(
        s.alias("span_start"), F.least(F.date_add(s, days - 1), end).alias("span_end")))


def months_touched(start: Column, end: Column) -> Column:
    """First day of every calendar month that [start, end] touches."""
    return F.sequence(F.trunc(start, "month"), end, F.expr("interval 1 month"))


def usable_odds(odds: Column) -> Column:
    """Map runner → struct(odds …) reduced to runner → odds, dropping empty and zero."""
    plain = F.transform_values(odds, lambda _, v: v["odds"])
    return F.map_filter(plain, lambda _, v: v.isNotNull() & (v != 0))
