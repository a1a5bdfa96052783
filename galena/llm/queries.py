"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galena.llm import op1_secrets, op2_language, op3_decontamination, op4_quality, op5_toxicity, op6_packing, op7_neardup, op8_warc, op9_urls, op10_media
from galena.llm._base import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secrets.digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_language.digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.pack(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_neardup.digest(table(spark, sf_dir, "documents"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.digest(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_urls.judge(table(spark, sf_dir, "pages"))


def op10_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media.digest(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_secret_scan,
    op2_language_id,
    op3_decontaminate,
    op4_quality_score,
    op5_toxicity_score,
    op6_pack,
    op7_near_duplicates,
    op8_warc_archive,
    op9_url_filter,
    op10_media_webp,
)

#: Payloads of 1000 bytes or more are stored once, by the row with the largest id.
OP8_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM w
"""

#: All links by a join on the shingles, and what is reachable over them.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, v) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.v
), m AS (
  SELECT id, min(v) AS c FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_near_duplicates": OP7_SQL, "op8_warc_archive": OP8_SQL}
