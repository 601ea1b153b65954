"""The numbered queries and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, annparts, exactdedup, heapmeans, langid, licenses, media, minhash, packing, quality, secrets, secrets_sql, spviterbi, urlfilter
from .shared import documents


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spviterbi.encode_documents(documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annparts.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(documents(spark, sf_dir))


def op12_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heapmeans.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_urls": op2_urls,
    "op3_pieces": op3_pieces,
    "op4_language": op4_language,
    "op5_licenses": op5_licenses,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_media": op8_media,
    "op9_packing": op9_packing,
    "op10_minhash": op10_minhash,
    "op11_alignment": op11_alignment,
    "op12_exact": op12_exact,
    "op13_centroids": op13_centroids,
}

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS shared FROM x p JOIN x q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n_shingles + nb.n_shingles - shared)
), reach AS (
  SELECT doc_id, doc_id AS seen FROM n
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.seen
)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1) c ON c.doc_id = n.doc_id
"""

SQL: dict[str, str] = {
    "op1_secrets": secrets_sql.sql(),
    "op2_urls": urlfilter.sql(),
    "op10_minhash": OP10_SQL,
    "op12_exact": exactdedup.SQL,
    "op13_centroids": heapmeans.sql(),
}
