"""The registered queries of this subpackage; their oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from raceflow.llm import (decontaminate, kneser_ney, langid, mixing, neardup, perplexity, phrases, sharding, simhash, syncmers,
                          toxicity, warc, whitening)
from raceflow.llm.rows import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run
    return add


@query("op1_word_first_langid")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


WORDS_SQL = r"""
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents)
"""


@query("op2_minhash_bayes", rf"""
WITH RECURSIVE {WORDS_SQL.strip()},
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS n_u, b.n AS n_v, count(*) AS c
  FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * c >= 80 * (n_u + n_v - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sets
  UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id,
  s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


@query("op3_balanced_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op4_closed_syncmers")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_kneser_ney_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))


@query("op6_perplexity_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_boosted_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_capture_index", """
WITH made AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(hex, i, 1)) - 1) + 1, 4)), '') AS b FROM made),
named AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
      + CAST(substr(b, 5 * i + 5, 1) AS INT) + 1, 1)), '') AS payload_digest
  FROM bits)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
FROM named WINDOW same AS (PARTITION BY payload_digest)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_soft_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_containment_search", rf"""
WITH {WORDS_SQL.strip()},
items AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark),
item_sets AS (
  SELECT item_id, least(len(w), 5) AS k, list_distinct(list_transform(
    range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM items WHERE len(w) > 0),
item_parts AS (SELECT item_id, k, len(s) AS n_item, unnest(s) AS x FROM item_sets),
doc_parts AS (
  SELECT doc_id, k, unnest(list_distinct(list_transform(
    range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS x
  FROM words, (SELECT DISTINCT k FROM item_sets) WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS hits, n_item, count(*) / n_item AS containment
FROM doc_parts JOIN item_parts USING (k, x) GROUP BY doc_id, item_id, n_item
HAVING count(*) >= 0.8 * n_item - 1e-9
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_simhash_ball")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query("op12_hat_trie_phrases", r"""
WITH worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
seen AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM seen WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN seen x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN seen y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL),
placed AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, CAST(p.score AS BIGINT) AS score
FROM placed p JOIN totals t USING (lang) WHERE p.rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


@query("op13_whitened_embeddings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
