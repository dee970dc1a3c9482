"""Sharding by balanced label propagation (DataFrame operations only).

Documents are linked through hubs: all documents of equal texts share one, and a table of
links (doc_id, hub) may name others, such as passages that several documents hold. Links are
never spelled out as pairs. Every document starts in a shard chosen by its id. In each round a document's
neighbours are counted by their current shard (an array a hub, joined to the hub's links and added up);
it wishes for the shard that holds most of them, and moves there if that keeps more neighbours,
with the chance that the shard's room and its own leavers allow. Half of the documents, by a hash, may move
in a round, so that two neighbours do not change places for ever.

Then the labels are settled under exact quotas. A group of equal texts larger than a shard fills whole
shards one after another. Other large groups are seated next, largest first; then every waiting group asks
in rounds to gather in the shard that holds most of its members among those with room left, and is seated
whole if the room lasts, until no group moves; the last few refused groups are seated in one step. Documents
that only other hubs link keep their label while there is room. What is left of groups larger than a shard, and
documents without links, fill the places left, so row counts differ by one at most.

Null texts link to nothing, empty texts are equal to each other, repeated rows are rows of their own that
move together. Very long texts are only hashed. Ties go to the shard of a hash. Links of unknown or null ids and hubs
of one document say nothing. An empty table gives an empty result. Only the two named columns of
the input are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow.llm.rows import CHUNK_ROWS, gapless, join_hot
from raceflow.session import cut_lineage, release

FEW = 1_000  # groups that one driver step seats


def _case(shards: int, values: list[int]) -> Column:
    """values[shard] as a column; one value for each shard."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values[:shards]]), F.col("shard") + 1)


def _inlined(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of numbers (longs) without a file or an executor's Python."""
    cells = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.inline(cells))


def _pick(at: Column, free: list[int]) -> Column:
    """The shard whose part of 0 … sum(free) - 1 holds ``at``."""
    ends = [sum(free[:s + 1]) for s in range(len(free))]
    return reduce(lambda rest, s: F.when(at < ends[s], F.lit(s)).otherwise(rest), reversed(range(len(free))), F.lit(0))


def _round(nodes: DataFrame, links: DataFrame, quota: list[int], number: int) -> DataFrame:
    """One round of propagation over ``nodes`` (node, weight, shard) and ``links`` (node, hub), all stored."""
    shards = range(len(quota))
    placed = cut_lineage(links.join(nodes, "node"))
    here = [F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0)) for s in shards]
    votes = cut_lineage(placed.groupBy("hub").agg(F.array(*here).alias("votes"), F.count(F.lit(1)).alias("many")))
    around = join_hot(placed, votes, ["hub"], "many", placed.count())
    sums = [(F.sum(F.get("votes", s)) - F.when(F.col("shard") == s, F.sum("weight")).otherwise(0)).alias(f"v{s}") for s in shards]
    seen = around.groupBy("node", "shard", F.col("weight").alias("w")).agg(*sums)
    ranked = [F.struct(F.col(f"v{s}").alias("v"), F.xxhash64("node", F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in shards]
    own = F.get(F.array(*[F.col(f"v{s}") for s in shards]), F.col("shard"))
    wishes = seen.select("node", "shard", "w", F.greatest(*ranked).alias("best"), own.alias("own")).filter(
        (F.col("best.v") > F.col("own")) & (F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0))
    wishes = cut_lineage(wishes.select("node", "w", "shard", F.col("best.s").alias("want")))
    flows = [nodes.groupBy("shard").agg(F.sum("weight").alias("n")), wishes.groupBy(F.col("want").alias("shard")).agg(F.sum("w").alias("n")),
             wishes.groupBy("shard").agg(F.sum("w").alias("n"))]
    held, asked, leaving = ({r["shard"]: r["n"] for r in f.collect()} for f in flows)  # a row per shard
    chance = [min(1.0, max(0, quota[s] - held.get(s, 0) + leaving.get(s, 0)) / max(1, asked.get(s, 0))) for s in shards]
    drawn = F.pmod(F.xxhash64("node", F.lit(number + 500)), F.lit(1 << 20)) < F.get(F.array(*[F.lit(c) for c in chance]), F.col("want")) * (1 << 20)
    moved = wishes.filter(drawn).select("node", "want")
    return cut_lineage(nodes.join(moved, "node", "left").select("node", "weight", F.coalesce("want", "shard").alias("shard")))


def labels(nodes: DataFrame, links: DataFrame, quota: list[int], rounds: int) -> DataFrame:
    """The shards (node, weight, shard) after ``rounds`` rounds."""
    for number in range(rounds):
        nodes = _round(nodes, links, quota, number)
        release(nodes.sparkSession)
    return nodes


def _granted(waiting: DataFrame, votes: DataFrame, free: list[int], number: int, groups: int) -> DataFrame:
    """One round: (hub, members, shard) of the waiting groups whose wish fits into the room left.

    A group wishes for the shard that holds most of its members among those with room for
    all of it, else for any shard, drawn by its room. Wishes are granted in the order of a hash.
    """
    shards, room = len(free), F.array(*[F.lit(x).cast("long") for x in free])
    own = votes.filter(F.element_at(room, F.col("shard") + 1) >= F.col("members")).groupBy("hub").agg(
        F.max_by("shard", F.struct("here", F.xxhash64("hub", "shard"))).alias("want"))
    drawn = _pick(F.pmod(F.xxhash64("hub", F.lit(number)), F.lit(max(1, sum(free)))), free)
    wishes = waiting.join(own, "hub", "left").select(
        "hub", "members", F.coalesce("want", drawn).cast("int").alias("shard"),
        F.xxhash64("hub", F.lit(number + 1000)).alias("order"))
    parts = max(16, groups // CHUNK_ROWS)
    wishes = cut_lineage(wishes.withColumn("part", F.shiftrightunsigned("order", 1) % parts))
    sums = wishes.groupBy("shard", "part").agg(F.sum("members").alias("all"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    sums = sums.select("shard", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy("order", "hub").rowsBetween(Window.unboundedPreceding, 0)
    placed = wishes.withColumn("upto", F.sum("members").over(within)).join(F.broadcast(sums), ["shard", "part"])
    return placed.filter(F.col("before") + F.col("upto") <= F.element_at(room, F.col("shard") + 1)).select("hub", "members", "shard")


def _greedy(groups: list[tuple[int, int]], here: dict[tuple[int, int], int], free: list[int]) -> list[tuple[int, int, int]]:
    """(hub, members, shard) of the groups that fit whole, largest first; ``free`` is lowered."""
    out = []
    for hub, members in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = [s for s in range(len(free)) if free[s] >= members]
        if fits:
            best = max(fits, key=lambda s: (here.get((hub, s), 0), free[s], -s))
            free[best] -= members
            out.append((hub, members, best))
    return out


def _seats(linked: DataFrame, quota: list[int], rounds: int) -> tuple[DataFrame, list[tuple[int, int, int, int]], list[int]]:
    """(hub, seat) of every group seated whole, the whole shards (hub, first, after last, shard) that parts
    of larger groups fill, and the room left in each shard."""
    spark, free, out = linked.sparkSession, list(quota), []
    names = ["hub", "members", "shard"]
    votes = cut_lineage(linked.groupBy("hub", "members", "shard").agg(F.count(F.lit(1)).alias("here")))

    def place(waiting: DataFrame) -> None:
        """Seat these few groups on the driver."""
        few = votes.join(waiting.select("hub"), "hub", "left_semi").collect()
        rows = _greedy(list({(r["hub"], r["members"]) for r in few}), {(r["hub"], r["shard"]): r["here"] for r in few}, free)
        if rows:
            out.append(_inlined(spark, rows, names))

    # groups of more than a quarter of a shard are fewer than five a shard, those beyond a shard fewer than the shards
    groups = cut_lineage(votes.select("hub", "members").distinct())
    segments: list[tuple[int, int, int, int]] = []
    for hub, members in sorted(groups.filter(F.col("members") > max(quota)).collect(), key=lambda g: (-g[1], g[0])):
        here, at = {r["shard"]: r["here"] for r in votes.filter(F.col("hub") == hub).collect()}, 0
        for s in sorted(range(len(free)), key=lambda s: (-here.get(s, 0), s)):
            if free[s] and free[s] == quota[s] <= members - at:
                segments.append((hub, at, at + quota[s], s))
                at, free[s] = at + quota[s], 0
    large = F.col("members") * 4 > min(quota)
    place(groups.filter(large & (F.col("members") <= max(quota))))
    waiting = groups.filter(~large)
    left, number, still = waiting.count(), 0, 0
    while left and still < 2:
        if number >= rounds and left <= FEW:
            place(waiting)
            break
        seated = cut_lineage(_granted(waiting, votes, free, number, left))
        for r in seated.groupBy("shard").agg(F.sum("members").alias("n")).collect():  # a row per shard
            free[r["shard"]] -= r["n"]
        out.append(seated)
        waiting = cut_lineage(waiting.join(seated, "hub", "left_anti"))
        before, left = left, waiting.count()
        number, still = number + 1, still + 1 if left == before else 0
        release(spark)
    none = spark.range(0).select(*[F.col("id").alias(n) for n in names])
    return reduce(lambda x, y: x.unionByName(y), out, none).select(
        "hub", F.col("shard").cast("int").alias("seat")), segments, free


def cut_links(placed: DataFrame) -> DataFrame:
    """linked groups, groups kept whole, and documents outside their group's main shard."""
    here = placed.filter("hub IS NOT NULL").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("here"))
    groups = here.groupBy("hub").agg(F.sum("here").alias("members"), F.max("here").alias("most"))
    return groups.filter("members > 1").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("members") == F.col("most")).alias("whole"),
        F.coalesce(F.sum(F.col("members") - F.col("most")), F.lit(0)).alias("apart"))


def propagate(docs: DataFrame, shards: int = 16, rounds: int = 3, id_col: str = "doc_id",
              text_col: str = "text", links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, hub (hash of the text), shard, slot for every row of ``docs``.

    ``links`` (doc_id, hub: a long) names further hubs.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("hub"))
    base = cut_lineage(base.withColumn("node", F.xxhash64("doc_id", "hub", "size")))
    rows = base.count()
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    hubs = base.filter("hub IS NOT NULL").groupBy("hub").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    hubs = cut_lineage(hubs)
    start = F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int").alias("shard")
    base = cut_lineage(join_hot(base, hubs, ["hub"], "members", rows).select("*", start))
    ties = base.filter("members IS NOT NULL").select("node", "hub")
    if links is not None:
        named = links.select(F.col("doc_id").alias("_id"), F.xxhash64("hub", F.lit("named")).alias("_hub")).dropna().distinct()
        named = base.select("node", "doc_id").join(named, F.col("doc_id") == F.col("_id")).select("node", F.col("_hub").alias("hub"))
        shared = named.groupBy("hub").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("hub")
        ties = ties.unionByName(named.join(shared, "hub", "left_semi").select("node", "hub"))
    if rounds:
        ties = cut_lineage(ties.distinct())
        nodes = base.groupBy("node", "shard").agg(F.count(F.lit(1)).alias("weight"))
        nodes = cut_lineage(nodes.join(ties.select("node").distinct(), "node", "left_semi").select("node", "weight", "shard"))
        found = cut_lineage(labels(nodes, ties, quota, rounds).select("node", F.col("weight").alias("same"), F.col("shard").alias("label")))
        base = cut_lineage(join_hot(base, found, ["node"], "same", rows))
        linked = base.filter("members IS NOT NULL").withColumn("shard", F.coalesce("label", "shard"))
        seats, segments, free = _seats(linked, quota, rounds)
        seated = linked.join(seats, "hub", "left")
        if segments:
            large = sorted({h for h, _, _, _ in segments})
            parts = gapless(linked.filter(F.col("hub").isin(large)), rows, "hub", F.col("node"), ["node", "doc_id"], "at")
            seat = reduce(lambda rest, g: F.when((F.col("hub") == g[0]) & F.col("at").between(g[1], g[2] - 1), F.lit(g[3])).otherwise(rest),
                          segments, F.lit(None).cast("int"))
            seated = seated.filter(~F.col("hub").isin(large)).unionByName(parts.withColumn("seat", seat).drop("at"))
        single = gapless(base.filter("members IS NULL AND label IS NOT NULL").withColumn("shard", F.col("label")),
                         rows, "shard", F.col("node"), ["node", "doc_id"], "at")
        single = single.withColumn("seat", F.when(F.col("at") < _case(shards, free), F.col("shard"))).drop("at")
        seated = cut_lineage(seated.unionByName(single))
        base = base.filter("members IS NULL AND label IS NULL")
    else:  # every document stays where it starts
        linked = base.filter("members IS NOT NULL")
        seated = gapless(linked, rows, "shard", F.xxhash64("doc_id"), ["doc_id", "hub"])
        seated = cut_lineage(seated.withColumn("seat", F.when(F.col("slot") < _case(shards, quota), F.col("shard"))).drop("slot"))
        base = base.filter("members IS NULL")
    taken = {r["seat"]: r["n"] for r in seated.groupBy("seat").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shard
    held = [taken.get(s, 0) for s in range(shards)]
    free = [quota[s] - held[s] for s in range(shards)]
    kept = seated.filter("seat IS NOT NULL").withColumn("shard", F.col("seat"))
    together = F.when(F.coalesce("members", F.lit(0)) > F.lit(CHUNK_ROWS), F.xxhash64("doc_id")).otherwise(F.coalesce("hub", "node"))
    kept = gapless(kept, rows, "shard", together, ["hub", "doc_id"])
    loose = (seated.filter("seat IS NULL").select(base.columns).unionByName(base).withColumn("_all", F.lit(0)))
    loose = gapless(loose, rows, "_all", F.col("doc_id"), ["doc_id", "hub"], "place").drop("_all")
    first = [sum(free[:s]) for s in range(shards)]
    shard = reduce(lambda rest, s: F.when((F.col("place") >= first[s]) & (F.col("place") < first[s] + free[s]),
                                          F.lit(s)).otherwise(rest), range(shards), F.lit(None).cast("int"))
    loose = loose.withColumn("shard", shard).withColumn(
        "slot", F.col("place") - _case(shards, first) + _case(shards, held))
    out = ["doc_id", "size", "text_crc32", "hub", "shard", "slot"]
    return kept.select(out).unionByName(loose.select(out))


def shared_lines(docs: DataFrame, least: int = 40) -> DataFrame:
    """Links (doc_id, hub) through lines of at least ``least`` characters that documents hold, a hash a line.

    White space around a line does not count. A line that only one document holds links nothing.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    hubs = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= least), lambda x: F.xxhash64(x)))
    links = docs.select("doc_id", F.explode(hubs).alias("hub")).filter("doc_id IS NOT NULL")
    links = cut_lineage(links)
    shared = links.groupBy("hub").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("hub")
    return cut_lineage(links.join(shared, "hub", "left_semi").select("doc_id", "hub"))


def kept_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of neighbours that links (doc_id, hub) tie, and how many of them share a shard (from counts, not pairs)."""
    here = links.join(placed.select("doc_id", "shard"), "doc_id").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    hubs = here.groupBy("hub").agg(F.sum("n").alias("n"), F.sum(pairs).alias("kept"))
    return hubs.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("kept"), F.lit(0.0)).alias("kept"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 3, links: DataFrame | None = None) -> DataFrame:
    """The contract's columns; the law is ``rows``, so no grown shard is given."""
    placed = propagate(docs, shards, rounds, links=links)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
                         F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
