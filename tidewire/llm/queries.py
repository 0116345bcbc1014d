"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import ann, exact_dedup, html_text, licenses, line_dedup, mixing, packing, prefix_trie, quality, repair, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the group of its normalised text."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity, the model fitted on a sample of labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(*toxicity.sampled_features(docs, table(spark, sf_dir, "labels"))))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that nearly repeat an earlier one."""
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the sequences."""
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.fair_mix(table(spark, sf_dir, "documents"))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.curve_shards(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of good quality, learned without the held-out ids."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_line_dedup, op4_nn_descent, op5_best_fit_packing, op6_license_scan, op7_mixing, op8_hilbert_sharding, op9_html_text, op10_simhash, op11_prefix_trie, op12_quality, op13_repair)}


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM src),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, coalesce(least(cap, w * max(CASE WHEN level <= cap / w THEN level END) OVER ()), cap) AS target FROM levels),
queue AS (
  SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
events AS (
  SELECT q.*, e.epoch, cum + e.epoch * source_size AS upto, (cum + e.epoch * source_size) / target AS finish
  FROM queue q, (VALUES (0), (1)) e(epoch) WHERE target > 0 AND size > 0),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, coalesce('s' || source, 'n'), epoch, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS total FROM events),
reached AS (
  SELECT source, max(upto) AS reached FROM placed WHERE total <= 1.5::DOUBLE * (SELECT sum(source_size) FROM targets) GROUP BY source)
SELECT doc_id, q.source, size, source_size, target,
       (CASE WHEN cum <= reached THEN size ELSE 0 END + CASE WHEN cum + source_size <= reached THEN size ELSE 0 END)::BIGINT AS taken
FROM queue q LEFT JOIN reached r ON q.source IS NOT DISTINCT FROM r.source
"""

OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
         list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substring(conv_id::VARCHAR, i, 1))::BIGINT) AS bytes FROM t),
crc AS (  -- CRC-32 of the decimal id, bit by bit
  SELECT conv_id, base, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b: list_reduce(
    list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)), 4294967295::BIGINT) % 4 AS h FROM ids),
rebuilt AS (
  SELECT crc.conv_id, 0 AS part, pos, k, text FROM crc JOIN t ON t.conv_id = crc.base AND pos <= h
  UNION ALL SELECT crc.conv_id, 1, pos, k, text FROM crc JOIN t ON t.conv_id = crc.conv_id AND pos > h),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM rebuilt),
paths AS (
  SELECT conv_id, d, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
nodes AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY 1, 2),
ends AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM paths GROUP BY 1) GROUP BY 1),
kids AS (SELECT path[:-65] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT a.path, count(*) FILTER (kids.n IS NULL) AS leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) LEFT JOIN kids ON kids.path = b.path GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.path[:-65]
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op7_mixing": OP7_SQL, "op11_prefix_trie": OP11_SQL}
