"""Sources and sinks: each query writes below the shared folder and reads back."""

from pyspark.sql import functions as F

from raceflow import skew
from raceflow.bindings import KEY, LOG_SQL, entrants, hot_races, log_lines, table, with_entrants
from raceflow.functions.text import int_or_null
from raceflow.operators import keys, logs, outcomes
from raceflow.registry import query
from raceflow.session import cut_lineage, release, scratch_path
from raceflow.sources import files, pages
from raceflow.streaming import incremental

K = "race_id, horse_id, jockey_id, bracket_number"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("race_date"))


@query("read_by_date", "S1", """
  SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'""")
def read_by_date(spark, sf):
    return files.read_by_date(spark, f"{sf}/orders.parquet", "1997-03-01", "1997-09-30", "o_orderdate").select(
        "o_orderkey", "o_custkey")


@query("read_by_text_date", "S1", """
  SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30' AND o_orderkey % 7 <> 0""")
def read_by_text_date(spark, sf):
    text = F.when(F.col("o_orderkey") % 7 == 0, "unknown").otherwise(F.col("race_date").cast("string"))
    path = scratch_path(spark, "by-date")
    _orders(spark, sf).withColumn("race_date", text).write.parquet(path)
    return files.read_by_date(spark, path, "1997-03-01", "1997-09-30").select("o_orderkey")


@query("read_partitions", "S2 S4 S6", """
  SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day FROM orders
  WHERE year(o_orderdate) = 1998 AND month(o_orderdate) IN (1, 2, 3)""")
def read_partitions(spark, sf):
    path = scratch_path(spark, "features")
    files.write_partitioned(files.partition_columns(_orders(spark, sf)), path, ["year", "month"])
    return files.read_partitions(spark, path, year=1998, month=[1, 2, 3]).select("o_orderkey", "year", "month", "day")


@query("read_latest_per_partition", "S3", "SELECT o_orderkey, 2 AS pass, year(o_orderdate) AS year FROM orders WHERE o_orderkey % 2 = 0")
def read_latest_per_partition(spark, sf):
    path = scratch_path(spark, "latest")
    df = _orders(spark, sf).select("o_orderkey", F.year("race_date").alias("year"))
    for n, rows in ((1, df), (2, df.filter("o_orderkey % 2 = 0"))):
        rows.withColumn("pass", F.lit(n)).repartition("year").write.mode("append").partitionBy("year").parquet(path)
    return files.read_latest_per_partition(spark, path).select("o_orderkey", "pass", "year")


@query("write_partitioned", "S4", """
  SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN year(o_orderdate) = 1999 THEN 2 ELSE 1 END AS pass FROM orders
  WHERE year(o_orderdate) <> 1999 OR o_orderstatus = 'O'""")
def write_partitioned(spark, sf):
    """Writing 1999 again replaces that year only."""
    path = scratch_path(spark, "partitioned")
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    files.write_partitioned(df.withColumn("pass", F.lit(1)), path, ["year"])
    files.write_partitioned(df.filter("year = 1999 AND o_orderstatus = 'O'").withColumn("pass", F.lit(2)), path, ["year"])
    return spark.read.parquet(path).select("o_orderkey", "year", "pass")


@query("write_single_result", "S5", "SELECT c_custkey, c_mktsegment, 1 AS files FROM customer")
def write_single_result(spark, sf):
    path = scratch_path(spark, "single")
    files.write_files(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path, files=1)
    back = spark.read.parquet(path)
    return back.withColumn("files", back.select(F.countDistinct("_metadata.file_name")).scalar())


@query("derive_partition_columns", "S6", """
  SELECT o_orderkey, year(d) AS year, month(d) AS month, day(d) AS day FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN DATE '2024-05-06' ELSE CAST(o_orderdate AS DATE) END AS d FROM orders)""")
def derive_partition_columns(spark, sf):
    df = _orders(spark, sf).select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("race_date")).alias("race_date"),
                                   F.concat(F.lit("20240506"), F.lpad(F.col("o_orderkey").cast("string"), 4, "0")).alias("race_id"))
    return files.partition_columns(df, "race_date", "race_id").select("o_orderkey", "year", "month", "day")


@query("csv_round_trip", "S7", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path, byte_order_mark=True)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("outcome_documents", "S8 B4", with_entrants("""
  SELECT CAST(race_id AS STRING) AS race_id, CAST(horse_number AS STRING) AS key, market,
         round(CASE market WHEN 'win' THEN win_probability ELSE least(1.0, 3 * win_probability) END, 7) AS probability, head_count AS entries
  FROM entrants, (SELECT unnest(['win', 'place']) AS market)"""))
def outcome_documents(spark, sf):
    """Two versions are stored; the newer one of every race is read, dealt by race once and packed into documents."""
    df = cut_lineage(entrants(spark, sf, ["race_id", "horse_number", "win_probability"]))  # written twice
    p = F.col("win_probability")
    path = scratch_path(spark, "outcomes")
    for day, scale in (("2024-01-01", 0.5), ("2024-01-02", 1.0)):
        rows = df.select("race_id", F.col("horse_number").alias("runner"), (p * scale).alias("win"), F.least(F.lit(1.0), 3 * p).alias("place"))
        outcomes.outcome_rows(rows, {"win": "win", "place": "place"}, "v1", F.lit(f"{day}T00:00:00")).write.mode("append").json(path, compression="gzip")
    release(spark)
    newest = files.latest_rows(files.read_outcomes(spark, path), ["race_id", "model_id"], "created_ts")
    newest = newest.select("race_id", "market", "key", "probability")
    out = skew.by_part(newest, ["race_id"], [(str(race),) for race, in hot_races(spark, sf)], _documents)
    return out.select("race_id", "key", "market", F.round("probability", 7).alias("probability"), "entries")


def _documents(rows, hot):
    """The rows by way of documents, with the entries of their race; a race that is not hot stays in one task."""
    rows = rows.repartition("race_id") if hot == [] else rows
    docs = outcomes.pack(rows, ["race_id", "market"], "key", "probability", "probs", parts=3)
    docs = skew.over_group(docs, ["race_id", "market"], {"entries": F.sum(F.size("probs"))}, hot)
    return outcomes.unpack(docs, ["race_id", "market"], "probs", keep=["entries"])


@query("latest_odds_snapshot", "S9 F32", with_entrants("""
  SELECT CAST(race_id AS STRING) AS race_id, CAST(horse_number AS STRING) AS key,
         CASE WHEN race_id % 2 = 0 THEN win_odds * 2 ELSE win_odds END AS odds FROM entrants WHERE horse_number <> 2"""))
def latest_odds_snapshot(spark, sf):
    df = entrants(spark, sf, ["race_id", "horse_number", "win_odds"])
    path = scratch_path(spark, "odds")
    for stamp, even_only, factor in (("2024-01-01 09:00:00", False, 1), ("2024-01-01 10:00:00", True, 2)):
        taken = (F.col("race_id") % 2 == 0) | F.lit(not even_only)
        odds = F.when(F.col("horse_number") != 2, F.col("win_odds") * factor).otherwise(0.0)
        df.filter(taken).select(F.col("race_id").cast("string").alias("race_id"), F.lit(stamp).alias("snapshot_ts"), F.lit("win").alias("market"),
                                F.col("horse_number").cast("string").alias("key"), odds.alias("odds"),
                                F.lit(1).alias("popularity")).write.mode("append").json(path)
    newest = files.latest_rows(spark.read.schema(files.ODDS_SCHEMA).json(path), ["race_id"], "snapshot_ts")
    return files.usable_odds_rows(newest).select("race_id", "key", "odds")


@query("log_files", "S10", f"WITH {LOG_SQL} SELECT level, module, count(*) AS lines FROM log GROUP BY ALL")
def log_files(spark, sf):
    path = scratch_path(spark, "logs")
    log_lines(spark, sf).select("line").write.text(path)
    return logs.counts_by(logs.parsed(files.read_log(spark, path, "*.txt")), "level", "module")


@query("page_charset", "S11", """
  SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '稍重 ' || url ELSE '芝1600 ダート ' || url END AS text FROM pages""")
def page_charset(spark, sf):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        euc = F.encode(F.concat(F.lit("芝1600 ダート "), "url"), "EUC-JP")
        utf = F.encode(F.concat(F.lit("稍重 "), "url"), "UTF-8")
        stored = table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 2, utf).otherwise(euc).alias("content"))
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    return pages.with_page_text(stored, "content", "text").drop("content")


@query("quarantine_split", "S12", """
  SELECT 'good' AS side, l_orderkey AS source, NULL::VARCHAR AS message FROM lineitem WHERE l_linenumber NOT IN (3, 5)
  UNION ALL SELECT 'bad', l_orderkey, CASE l_linenumber WHEN 3 THEN 'finish: DNF' ELSE 'finish: ---' END FROM lineitem
    WHERE l_linenumber IN (3, 5)""")
def quarantine_split(spark, sf):
    raw = F.when(F.col("l_linenumber") == 3, "DNF").when(F.col("l_linenumber") == 5, "---").otherwise(
        F.col("l_linenumber").cast("string"))
    df = table(spark, sf, "lineitem").select("l_orderkey", raw.alias("finish")).withColumn("finish_n", int_or_null(F.col("finish")))
    good, bad = files.quarantine_split(df, "results", "l_orderkey", {"finish": "finish_n"}, F.current_timestamp())
    return good.select(F.lit("good").alias("side"), F.col("l_orderkey").alias("source"),
                       F.lit(None).cast("string").alias("message")).unionByName(bad.select(F.lit("bad").alias("side"), "source", "message"))


@query("repair_void_columns", "S13", "SELECT o_orderkey, NULL::DOUBLE AS morning_odds FROM orders")
def repair_void_columns(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.lit(None).alias("morning_odds"), F.lit(None).alias("blinkers"))
    return files.repair_void_columns(df, {"morning_odds": "double"})


@query("manifest_diff", "S14", """
  WITH named AS (SELECT DISTINCT p_brand || '/' || p_size AS feature, p_partkey % 2 = 0 AS listed FROM part)
  SELECT feature, CASE WHEN bool_or(listed) THEN 'missing' ELSE 'extra' END AS state FROM named GROUP BY feature
  HAVING count(DISTINCT listed) = 1
  UNION ALL SELECT 'distance_m', 'missing' UNION ALL SELECT 'p_type', 'extra'""")
def manifest_diff(spark, sf):
    """Names made from the odd parts against a stored manifest made from the even ones."""
    parts = table(spark, sf, "part")

    def names(rest, *more):
        rows = parts.filter(F.col("p_partkey") % 2 == rest)
        made = rows.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("feature")).distinct()
        return made.unionByName(files.manifest(spark, more))

    path = scratch_path(spark, "manifest")
    names(0, "p_size", "distance_m").write.parquet(path)
    return files.manifest_diff(spark.read.parquet(path), names(1, "p_size", "p_type"))


@query("audit_upsert", "S15 D1", """
  SELECT url, sha256(html) AS sha256, octet_length(encode(html)) AS size, page_id AS fetched FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id % 2 DESC, page_id DESC) AS r FROM (
      SELECT page_id, split_part(url, '/', 3) AS url, html FROM pages)) WHERE r = 1""")
def audit_upsert(spark, sf):
    fetched = table(spark, sf, "pages").select(F.col("page_id").alias("fetched"), F.split("url", "/")[2].alias("url"), "html")
    audit = files.audit_rows(fetched, "html", ["url", "fetched"])
    old, new = audit.filter("fetched % 2 = 0"), audit.filter("fetched % 2 = 1")
    return keys.upsert(old, new, ["url"], ["fetched"]).select("url", "sha256", "size", "fetched")


@query("data_version_record", "S16", """
  SELECT 'orders' AS "table", count(*) AS rows, CAST(min(o_orderdate) AS DATE)::VARCHAR AS first_day,
         CAST(max(o_orderdate) AS DATE)::VARCHAR AS last_day,
         sha256(string_agg(CAST(o_orderkey AS VARCHAR) || chr(10), '' ORDER BY o_orderkey)) AS sha256,
         CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS bytes, 1 AS files FROM orders""")
def data_version_record(spark, sf):
    """The record of a table, with the manifest of a file of its keys (one line each, in order)."""
    orders = _orders(spark, sf)
    path = scratch_path(spark, "keys")
    orders.orderBy("o_orderkey").select(F.col("o_orderkey").cast("string")).coalesce(1).write.text(path)
    found = files.file_manifest(spark, path, "*.txt").agg(
        F.max("sha256").alias("sha256"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).cast("int").alias("files"))
    version = files.data_version(orders, "orders", "race_date")
    return version.select("table", "rows", F.col("first_day").cast("string").alias("first_day"),
                          F.col("last_day").cast("string").alias("last_day"),
                          *[found.select(c).scalar().alias(c) for c in ("sha256", "bytes", "files")])


@query("rows_per_file", "S16", "SELECT count(*) AS rows, true AS twice_differs FROM orders")
def rows_per_file(spark, sf):
    """Rows by file, and a fingerprint that sees repeated rows."""
    orders = _orders(spark, sf).select("o_orderkey", "o_custkey")
    once, twice = scratch_path(spark, "once"), scratch_path(spark, "twice")
    orders.write.parquet(once)
    orders.unionByName(orders.filter("o_orderkey % 2 = 0")).unionByName(orders.filter("o_orderkey % 2 = 0")).write.parquet(twice)
    a, b = (files.file_rows(spark, p).agg(F.sum("rows").alias("rows"), F.sum("fingerprint").alias("f")) for p in (once, twice))
    return a.select("rows", (F.col("f") != b.select("f").scalar()).alias("twice_differs"))


@query("compact_daily_files", "S17", "SELECT event_id, user_id, dayofmonth(ts) AS day FROM events")
def compact_daily_files(spark, sf):
    daily, target = scratch_path(spark, "daily"), scratch_path(spark, "compacted")
    events = table(spark, sf, "events").select("event_id", "user_id", F.dayofmonth("ts").alias("day"))
    events.withColumn("folder", F.col("day")).write.partitionBy("folder").parquet(daily)
    files.compact(spark, daily, target)
    return spark.read.parquet(target)


@query("file_size_summary", "A38", """
  SELECT 'status=' || o_orderstatus AS folder, 1 AS files, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS total_bytes,
         CAST(CASE WHEN sum(length(CAST(o_orderkey AS VARCHAR)) + 1) < 5000 THEN 1 ELSE 0 END AS BIGINT) AS small_files
  FROM orders GROUP BY o_orderstatus""")
def file_size_summary(spark, sf):
    """Exact sizes of one text file of keys per order status."""
    path = scratch_path(spark, "sizes")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("line"), F.col("o_orderstatus").alias("status"))
    orders.repartition("status").write.partitionBy("status").text(path)
    return files.file_size_summary(spark, path, small_bytes=5000).filter("folder LIKE 'status=%'").select(
        "folder", F.col("files").cast("int").alias("files"), "total_bytes", "small_files")


@query("incremental_upsert", "D1 J6", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag DESC, l_partkey DESC, l_suppkey DESC) AS r
    FROM lineitem) WHERE r = 1""")
def incremental_upsert(spark, sf):
    """One batch per return flag, merged in order; later batches win. The table is opened
    anew for every batch and every batch is offered twice, as after a restart. Leaves split
    at 256 kB, so that they do at every size."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    key, order = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]
    place = scratch_path(spark, "upsert")
    flags = sorted(r[0] for r in lines.select("l_returnflag").distinct().collect())  # a handful
    for i, flag in enumerate(flags):
        batch = keys.upsert(lines.limit(0), lines.filter(F.col("l_returnflag") == flag), key, order)
        for _ in range(2):
            incremental.upsert_batch(incremental.VersionedTable(spark, place, key, parts=2, limit=1 << 18), order)(batch, i)
    return incremental.VersionedTable(spark, place, key).read().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("changed_data_blocks", "S16 S14", """
  WITH placed AS (
    SELECT o_orderkey AS k, o_orderkey // 4096 AS folder,
           (row_number() OVER (PARTITION BY o_orderkey // 4096 ORDER BY o_orderkey) - 1) // 64 AS block FROM orders),
  blocks AS (SELECT folder, block, bool_or(k % 1009 = 0) AS touched FROM placed GROUP BY ALL)
  SELECT 'folder=' || folder AS path, block, CASE WHEN folder % 7 = 3 THEN 'removed' ELSE 'changed' END AS state
  FROM blocks WHERE folder % 7 = 3 OR touched""")
def changed_data_blocks(spark, sf):
    """Blocks of 64 rows that differ between two stored copies of the orders: some rows have another
    customer, some folders are gone. Only the two hash trees are compared."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("folder", F.expr("o_orderkey div 4096"))
    other = F.when(F.col("o_orderkey") % 1009 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    trees = []
    for rows in (orders, orders.withColumn("o_custkey", other).filter("folder % 7 <> 3")):
        data, tree = scratch_path(spark, "blocks"), scratch_path(spark, "tree")
        rows.repartition("folder").sortWithinPartitions("folder", "o_orderkey").write.partitionBy("folder").parquet(data)
        files.hash_tree(files.block_manifest(spark, data, block_rows=64, by_folder=True)).write.parquet(tree)
        trees.append(spark.read.parquet(tree))
    return files.changed_blocks(*trees)
