"""Keeping hot keys out of single tasks.

A key that holds a large share of all rows must never reach one task whole.
Three situations occur:

* plain aggregates — Spark already combines on the map side, nothing to do;
* joins of two shuffled tables — AQE splits the skewed partitions;
* windows, and joins against an aggregate — handled here. The few hot keys are
  found by one column-pruned count, the rows are split into a cold and a hot
  part, the cold part takes the plain plan and the hot part a distributed one.

Which keys are called hot only decides the physical plan, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceflow.session import cut_lineage, release

# Keys with at least this many rows are hot; override per session with
# spark.raceflow.hotRows. At most HOT_LIMIT keys (the largest) are singled out,
# so the list is bounded; by counting, any key beyond it holds under 1/HOT_LIMIT
# of the rows.
HOT_ROWS = 2_000_000
HOT_LIMIT = 10_000
# Statistics tables up to this many bytes (rows times width) are broadcast.
BROADCAST_BYTES = 64 << 20
EVERYTHING = "everything"
# Rows that one task of a wide sort should get.
TASK_ROWS = 500_000
# The number of a row in a stored table.
ROW = "row_id"

Order = Sequence["str | tuple[str, bool]"]


def hot_rows_setting(spark) -> int:
    return int(spark.conf.get("spark.raceflow.hotRows", str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> list[tuple]:
    """The largest keys with at least ``min_rows`` rows (bounded list)."""
    floor = hot_rows_setting(df.sparkSession) if min_rows is None else min_rows
    rows = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= floor)
        .orderBy(F.desc("_n"), *keys).limit(HOT_LIMIT).collect()
    )
    return [tuple(r[k] for k in keys) for r in rows]


def same_keys(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Equality on all keys with NULL equal to NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], hot) -> tuple[DataFrame | None, DataFrame | None]:
    """(cold rows, hot rows); either may be None."""
    if isinstance(hot, str) and hot == EVERYTHING:
        return None, df
    if hot is None:
        hot = hot_keys(df, keys)
    if not hot:
        return df, None
    schema = df.select(*keys).schema
    listed = F.broadcast(df.sparkSession.createDataFrame(hot, schema))
    cond = same_keys(df, listed, keys)
    return df.join(listed, cond, "left_anti"), df.join(listed, cond, "left_semi")


def dealt(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int | None = None) -> DataFrame:
    """``df`` of about ``rows`` rows hashed by ``keys`` into as many tasks as keep each near ``task_rows`` (TASK_ROWS).

    Windows and aggregates on these keys (or more) follow without a further shuffle. The number is
    explicit, as adaptive execution goes by compressed bytes, of which a sort needs many times over.
    """
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(max(-(-rows // (task_rows or TASK_ROWS)), least), 1 << 15), *keys)


def by_part(df: DataFrame, keys: Sequence[str], hot, work: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """``work(rows, hot)`` on the cold rows and on the hot ones, and their union.

    Operators chained inside ``work`` pass the given ``hot`` on, so the input is split
    once for all of them: it is read once for the cold part and once to store the hot one.
    Groups are never divided between the parts.
    """
    cold, warm = split_hot(df, keys, hot)
    parts = [] if cold is None else [work(cold, [])]
    if warm is not None:
        parts.append(work(cut_lineage(warm), EVERYTHING))
    return reduce(DataFrame.unionByName, parts)


def row_bytes(df: DataFrame) -> int:
    """Width of a row as Spark holds it: 8 bytes a column, more for text."""
    return sum(32 if f.dataType.typeName() in ("string", "binary") else 16 for f in df.schema)


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def stored_all(tables: Sequence[DataFrame], at_once: int = 4) -> list[DataFrame]:
    """Materialise independent tables, a few jobs at a time so that the tail of one
    does not leave the cluster idle."""
    with ThreadPool(at_once) as pool:
        return pool.map(cut_lineage, tables)


def fits_broadcast(stats: DataFrame) -> bool:
    """Whether a stored table is small enough to be broadcast."""
    return stats.count() <= BROADCAST_BYTES // row_bytes(stats)


def lookup(df: DataFrame, stats: DataFrame, keys: Sequence[str], hot=None,
           null_matches: bool = False, stored: bool = False) -> DataFrame:
    """Left join per-key ``stats`` (one row per key) onto ``df``.

    The statistics are materialised once (unless already ``stored``) and sized: up to BROADCAST_BYTES
    they are broadcast and ``df`` does not move; beyond that ``df`` is shuffled,
    except its hot keys, whose few statistics rows are broadcast under the same limit.
    """
    def join(left, right):
        return attach(left, right, keys) if null_matches else left.join(right, list(keys), "left")

    columns = [*df.columns, *[c for c in stats.columns if c not in keys]]
    stats = stats if stored else cut_lineage(stats)
    if fits_broadcast(stats):
        return join(df, F.broadcast(stats)).select(columns)
    most = BROADCAST_BYTES // row_bytes(stats)
    if hot is None:
        hot = hot_keys(df, keys)
    if hot != EVERYTHING and len(hot) > most:
        hot = hot[:max(most, 1)]  # largest first; smaller ones are left to the skew join
    cold, warm = split_hot(df, keys, hot)
    if warm is None:
        return join(cold, stats).select(columns)
    _, few = split_hot(stats, keys, hot)
    parts = [join(cold, stats), join(warm, F.broadcast(few))]
    return reduce(DataFrame.unionByName, [p.select(columns) for p in parts])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` stored once with a number ROW that tells its rows apart, for ``assembled``."""
    return cut_lineage(df.withColumn(ROW, F.monotonically_increasing_id()))


def assembled(rows: DataFrame, pieces: Sequence[DataFrame]) -> DataFrame:
    """``numbered`` rows with the further columns of each piece (one row per number), without the number.

    Measures that need other partitionings are made on the few columns they read and meet here: a wide row
    moves once, by its number, however many pieces there are.
    """
    parts = [p for p in (rows, *pieces) if len(p.columns) > 1]
    packed = [p.select(ROW, F.struct(*[c for c in p.columns if c != ROW]).alias(f"_{i}")) for i, p in enumerate(parts)]
    together = reduce(lambda a, b: a.join(b, ROW, "left"), packed)
    return together.select(*[f"_{i}.*" for i in range(len(parts))])


def over_group(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], hot=None) -> DataFrame:
    """Add per-group aggregates to every row of the group."""
    cold, warm = split_hot(df, keys, hot)
    parts = []
    if cold is not None:
        w = Window.partitionBy(*keys)
        parts.append(cold.withColumns({n: a.over(w) for n, a in aggs.items()}))
    if warm is not None:
        totals = warm.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
        parts.append(attach(warm, F.broadcast(totals), keys))
    return reduce(DataFrame.unionByName, parts)


def _sort(order: Order, reverse: bool = False) -> list[Column]:
    """Sort columns with NULLs last (first when reversed)."""
    out = []
    for item in order:
        name, ascending = (item, True) if isinstance(item, str) else item
        if reverse:
            out.append(F.desc_nulls_first(name) if ascending else F.asc_nulls_first(name))
        else:
            out.append(F.asc_nulls_last(name) if ascending else F.desc_nulls_last(name))
    return out


def ordered_window(keys: Sequence[str], order: Order):
    return Window.partitionBy(*keys).orderBy(*_sort(order))


def history(df: DataFrame, keys: Sequence[str], order: Order,
            totals: dict[str, Column] | None = None,
            frames: dict[str, Callable] | None = None,
            lookback: int = 0, hot=None) -> DataFrame:
    """Running features per key in a total order.

    ``totals``  name → expression summed over all earlier rows (0 when none).
    ``frames``  name → ``f(window)`` looking at most ``lookback`` rows back.
    ``order``   column names, or (name, ascending); must be unique per key.

    Cold keys share one shuffle and one sort. Hot keys are cut into consecutive
    chunks by a range shuffle on (keys, order): earlier chunks contribute their
    sums as an offset and their last ``lookback`` rows as a lead-in.
    """
    totals, frames = totals or {}, frames or {}
    cold, warm = split_hot(df, keys, hot)
    parts = []
    if cold is not None:
        w = ordered_window(keys, order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        parts.append(cold.withColumns({
            **{n: F.coalesce(F.sum(e).over(before), F.lit(0)) for n, e in totals.items()},
            **{n: f(w) for n, f in frames.items()},
        }))
    if warm is not None:
        parts.append(_chunked_history(warm, keys, order, totals, frames, lookback))
    return reduce(DataFrame.unionByName, parts)


def _chunked_history(df, keys, order, totals, frames, lookback):
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = cut_lineage(
        df.repartitionByRange(n, *[F.asc(k) for k in keys], *_sort(order))
        .withColumn("_chunk", F.spark_partition_id())
    )
    chunk_keys = [*keys, "_chunk"]
    rows = base.withColumn("_lead_in", F.lit(False))
    if frames and lookback:
        last = (
            base.withColumn("_r", F.row_number().over(
                Window.partitionBy(*chunk_keys).orderBy(*_sort(order, reverse=True))))
            .filter(F.col("_r") <= lookback)
            .groupBy(*chunk_keys)
            .agg(F.sort_array(F.collect_list(F.struct(
                (-F.col("_r")).alias("_pos"),
                F.struct(*df.columns).alias("_row")))).alias("_tail"))
        )
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-lookback, -1)
        carried = (
            last.withColumn("_seq", F.flatten(F.collect_list("_tail").over(earlier)))
            .withColumn("_seq", F.slice("_seq", F.greatest(F.size("_seq") - lookback + 1, F.lit(1)),
                                        F.lit(lookback)))
            .select(F.col("_chunk"), F.explode("_seq").alias("_item"))
            .select("_item._row.*", "_chunk", F.lit(True).alias("_lead_in"))
        )
        rows = rows.unionByName(carried)
    w = ordered_window(chunk_keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(F.when(~F.col("_lead_in"), e)).over(before), F.lit(0))
           for n, e in totals.items()}
    out = rows.withColumns({**own, **{n: f(w) for n, f in frames.items()}}).filter(~F.col("_lead_in"))
    if totals:
        sums = base.groupBy(*chunk_keys).agg(*[F.sum(e).alias(f"_off_{n}") for n, e in totals.items()])
        earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
            "_chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*chunk_keys, *[
            F.coalesce(F.sum(f"_off_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in totals])
        # one row per (hot key, chunk): at most partitions + hot keys
        out = attach(out, F.broadcast(offsets), chunk_keys)
        out = out.withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in totals})
    return out.select(*df.columns, *totals, *frames)


def carry_forward(df: DataFrame, keys: Sequence[str], order: Order, value: Column, out: str, hot=None) -> DataFrame:
    """Add ``out``: the last non-NULL ``value`` of the key up to and with each row, in ``order`` (unique per key).

    Hot keys are cut into range chunks: a chunk's rows see the last value inside the chunk, or
    else the newest one that an earlier chunk ended with (one row per key and chunk).
    """
    columns = df.columns
    cold, warm = split_hot(df.withColumn("_value", value), keys, hot)
    parts = []
    if cold is not None:
        upto = ordered_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts.append(cold.withColumn(out, F.last("_value", ignorenulls=True).over(upto)))
    if warm is not None:
        n = int(warm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        base = cut_lineage(warm.repartitionByRange(n, *[F.asc(k) for k in keys], *_sort(order))
                           .withColumn("_chunk", F.spark_partition_id()))
        chunk_keys = [*keys, "_chunk"]
        newest = Window.partitionBy(*chunk_keys).orderBy(*_sort(order, reverse=True))
        ends = base.filter(F.col("_value").isNotNull()).withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
        ends = base.select(*chunk_keys).distinct().transform(
            lambda d: attach(d, ends.select(*chunk_keys, F.col("_value").alias("_end")), chunk_keys))
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*chunk_keys, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        upto = ordered_window(chunk_keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = base.withColumn("_inside", F.last("_value", ignorenulls=True).over(upto))
        # one row per (hot key, chunk): at most partitions + hot keys
        joined = attach(inside, F.broadcast(carried), chunk_keys)
        parts.append(joined.withColumn(out, F.coalesce("_inside", "_carried")))
    return reduce(DataFrame.unionByName, [p.select(*columns, out) for p in parts])


def rank_within(df: DataFrame, keys: Sequence[str], value: str, out: str, ascending: bool = True,
                method: str = "min", hot=None) -> DataFrame:
    """Rank of ``value`` in its group; ties share the lowest (``min``) or the mean
    (``average``) position. NULL values stay unranked."""
    def position(prior, n):
        rank = prior + 1 if method == "min" else prior + (n + F.lit(1)) / F.lit(2.0)
        return F.when(F.col(value).isNotNull(), rank.cast("long" if method == "min" else "double"))

    cold, warm = split_hot(df, keys, hot)
    parts = []
    if cold is not None:
        by = F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value)
        w = Window.partitionBy(*keys).orderBy(by)
        peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        parts.append(cold.withColumn(out, position(F.rank().over(w) - 1, peers)))
    if warm is not None:
        counts = warm.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
            F.count(F.lit(1)).alias("_n"))
        prior = history(counts, keys, [(value, ascending)], totals={"_prior": F.col("_n")}, hot=EVERYTHING)
        ranked = attach(warm, prior, [*keys, value])
        parts.append(ranked.withColumn(out, position(F.col("_prior"), F.col("_n"))).drop("_prior", "_n"))
    return reduce(DataFrame.unionByName, parts)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Order, out: str, hot=None) -> DataFrame:
    """1-based position in a total order within each group."""
    cold, warm = split_hot(df, keys, hot)
    parts = []
    if cold is not None:
        parts.append(cold.withColumn(out, F.row_number().over(ordered_window(keys, order)).cast("long")))
    if warm is not None:
        numbered = _chunked_history(warm, keys, order, {out: F.lit(1)}, {}, 0)
        parts.append(numbered.withColumn(out, (F.col(out) + 1).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def column_quantiles(df: DataFrame, columns: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of many columns, whatever their sizes.

    All columns become (column, value, n) rows in one shuffle, combined in the scan's tasks;
    running counts over them are computed in range chunks, and only the values at the
    wanted ranks reach the driver. The input is read once and the number of jobs does
    not depend on the number of columns. NULL and NaN do not count.
    """
    return part_quantiles([df], columns)


def part_quantiles(parts: Sequence[DataFrame], columns: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """``column_quantiles`` of a table that is given in parts, each with some of the columns for all rows. The values
    of a column are counted in the first part that has it, a part at a time; the shuffles of each are released."""
    names = list(columns)
    if not names:
        return {}
    counted, left = [], dict(enumerate(names))
    for part in parts:
        own = {i: name for i, name in left.items() if name in part.columns}
        left = {i: name for i, name in left.items() if i not in own}
        if not own:
            continue
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(name).cast("double").alias("v")) for i, name in own.items()])).alias("_x")
        counts = (part.select(cells).select("_x.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
                  .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
        counted.append(cut_lineage(counts))
        if len(parts) > 1:
            release(part.sparkSession)
    if left:
        raise ValueError(f"no part has the columns {sorted(left.values())}")
    counts = reduce(DataFrame.unionByName, counted)
    sizes = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # a row per column
    wanted: dict[int, list[int]] = {}
    for i, name in enumerate(names):
        for p in columns[name] if i in sizes else ():
            at = (sizes[i] - 1) * p
            wanted.setdefault(i, []).extend({int(at), min(int(at) + 1, sizes[i] - 1)})
    if not wanted:
        return {name: [None] * len(columns[name]) for name in names}
    ranks = counts.sparkSession.createDataFrame([(i, sorted(set(r))) for i, r in wanted.items()], "c int, ranks array<bigint>")
    running = history(counts, ["c"], ["v"], totals={"before": F.col("n")}, hot=EVERYTHING)
    placed = running.join(F.broadcast(ranks), "c").select(  # a row per column
        "c", "v", F.explode(F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).alias("r"))
    value = {(row["c"], row["r"]): row["v"] for row in placed.collect()}  # two values per quantile

    def quantile(i: int, p: float) -> float:
        at = (sizes[i] - 1) * p
        low, high = value[i, int(at)], value[i, min(int(at) + 1, sizes[i] - 1)]
        return low + (high - low) * (at - int(at))

    return {name: [quantile(i, p) if i in sizes else None for p in columns[name]] for i, name in enumerate(names)}


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    return column_quantiles(df, {column: list(probs)})[column]


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in column_quantiles(df, {c: [0.5] for c in columns}).items()}
