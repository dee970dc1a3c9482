"""Outcome probabilities as rows and as packed maps, and their audit.

Outcomes are stored as one row per (race, market, key). A packed document is only a
view of those rows; how many documents a race has is the caller's choice, not a
consequence of its size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_rows(probabilities: DataFrame, markets: dict[str, str], model_id: str, created: Column,
                 race: str = "race_id", runner: str = "runner") -> DataFrame:
    """The stored form: a row per race, market (name → probability column) and runner."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.col(c).cast("double").alias("probability"))
                               for m, c in markets.items()])).alias("_o")
    rows = probabilities.select(F.col(race).cast("string").alias("race_id"), F.col(runner).cast("string").alias("key"), each)
    return rows.select("race_id", F.lit(model_id).alias("model_id"), created.cast("string").alias("created_ts"),
                       "_o.market", "key", "_o.probability")


def pack(rows: DataFrame, race: str | Sequence[str], key: str, value: str, out: str, parts: int = 1) -> DataFrame:
    """Documents (race, part) with a map key → value of the keys that hash to the part; ``race`` may be several columns."""
    entry = F.struct(F.col(key).cast("string"), F.col(value))
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int").alias("part")
    return rows.groupBy(*_columns(race), part).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(out))


def unpack(documents: DataFrame, race: str | Sequence[str], column: str, key: str = "key", value: str = "probability",
           keep: Sequence[str] = ()) -> DataFrame:
    return documents.select(*_columns(race), *keep, F.explode(column).alias(key, value))


def _columns(race: str | Sequence[str]) -> list[str]:
    return [race] if isinstance(race, str) else list(race)


def audit(probabilities: DataFrame, race: str = "race_id", tolerance: float = 0.01) -> DataFrame:
    """Per race: Σ win, Σ place, field size, and whether they are 1 and min(3, n)."""
    sums = probabilities.groupBy(race).agg(F.sum("win").alias("win"), F.sum("place").alias("place"),
                                           F.count(F.lit(1)).alias("runners"))
    fits = ((F.abs(F.col("win") - 1) <= tolerance)
            & (F.abs(F.col("place") - F.least(F.col("runners"), F.lit(3))) <= tolerance))
    return sums.withColumn("fits", fits)


@cache
def leading_orders(top: int, length: int) -> list[tuple[int, ...]]:
    """Rank orders that can be among the ``top`` most probable ones of any race.

    Runners are ranked by falling probability. An order is at least as probable as one that
    has a lower-ranked runner in some places and the same elsewhere, so an order can be left out if
    ``top`` others are no worse in any place. The last place of an order then has a rank below
    top + length, whatever the size of the race.
    """
    least = tuple(range(1, length + 1))
    waiting, seen, out = [least], {least}, []
    while waiting:  # from the most probable order outwards; nothing beyond a dropped order is looked at
        order = waiting.pop()
        better = 0
        for other in permutations(range(1, max(order) + 1), length):
            better += other != order and all(a <= b for a, b in zip(other, order))
            if better >= top:
                break
        else:
            out.append(order)
            for rank in order:  # one runner a rank lower, changing places with the runner of that rank if it is in the order
                step = tuple({rank: rank + 1, rank + 1: rank}.get(x, x) for x in order)
                if len(set(step)) == length and step not in seen:
                    seen.add(step)
                    waiting.append(step)
    return sorted(out)


def _nested(values) -> str:
    """Nested numbers as the text of a constant array."""
    return f"array({', '.join(map(_nested, values))})" if isinstance(values, (list, tuple)) else str(values)


def top_orders(probabilities: DataFrame, top: int = 20, length: int = 3, race: str = "race_id", runner: str = "runner",
               win: str = "win", digits: int = 12) -> DataFrame:
    """The ``top`` most probable finishing orders of the first ``length`` places of each race.

    An order's probability is in closed form: each place goes to one of the runners left in
    proportion to their win probability. Only runners that can take part in a leading
    order are kept (``top + length - 1`` a race, limited before the shuffle), and only the orders of
    ``leading_orders`` that a field of the race's size can have are evaluated, as one array expression a race. Orders equal to ``digits``
    digits are ranked by their runners' ranks, runners of equal probability by key. Runners without
    a probability above 0 take no part; a race with fewer runners than places has no orders.
    """
    kept = probabilities.filter(F.col(win) > 0)
    best = Window.partitionBy(race).orderBy(F.desc(win), runner)
    kept = kept.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") < top + length)
    field = kept.groupBy(race).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(win).alias("p"), F.col(runner).alias("key")))).alias("_field"))
    # by field size from ``length`` on: the orders a race of that size can have
    sizes = [[order for order in leading_orders(top, length) if max(order) <= size] for size in range(length, top + length)]
    shapes = F.get(F.expr(_nested(sizes)), F.size("_field") - length)

    def order(shape: Column) -> Column:
        at = [F.get(F.col("_field"), F.get(shape, i) - 1) for i in range(length)]
        chance, left = at[0]["p"], F.lit(1.0)
        for before, here in zip(at, at[1:]):
            left = left - before["p"]
            chance = chance * F.when(left > 0, here["p"] / left)
        return F.struct((-F.round(chance, digits)).alias("lost"), shape.alias("shape"), F.array(*[a["key"] for a in at]).alias("runners"))

    ranked = F.slice(F.sort_array(F.filter(F.transform(shapes, order), lambda o: o["lost"].isNotNull())), 1, top)
    rows = field.select(race, F.posexplode(ranked).alias("_at", "_o"))
    return rows.select(race, (F.col("_at") + 1).alias("place"), F.col("_o.runners").alias("runners"), (-F.col("_o.lost")).alias("probability"))
