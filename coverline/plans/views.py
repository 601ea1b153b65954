"""The news tables as views over the driver's tables, for Spark and as SQL for DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(1998, 7, 1)
RUNS_AS_OF = datetime(2024, 1, 31)
AT = "TIMESTAMP '1998-07-01 00:00:00'"
RUNS_AT = "TIMESTAMP '2024-01-31 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    nation = lambda key, name: F.broadcast(t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name)))
    # a supplier's few columns and the names of nations come last, where a row is not shuffled again; before them orders, so that the articles of one lie together
    customers = t("customer").select("c_custkey", F.col("c_nationkey").alias("ck"))
    kind = [(F.col("o_orderstatus") == "P").alias("suspect"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")]
    orders = t("orders").select("o_orderkey", "o_custkey", *kind).join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    outlets = t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("sk"))
    rows = rows.join(outlets, F.col("l_suppkey") == F.col("s_suppkey")).join(nation("sk", "sn"), "sk").join(nation("ck", "cn"), "ck")
    pub = F.expr("timestamp_ntz'1998-06-01 00:00:00' + make_dt_interval(0, cast(l_orderkey % 720 as int))")
    created = F.expr("CASE WHEN l_linenumber = 7 THEN pub - INTERVAL '5' HOUR ELSE pub + make_dt_interval(0, cast(l_suppkey % 72 as int)) END")
    section = F.element_at(F.split(F.lit(",politics,business,sports,others,world"), ","), F.col("priority") + 1)
    return rows.withColumn("pub", pub).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("external_id"),
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("st-"), F.col("l_orderkey").cast("string"))).alias("stable_id"),
        F.col("pub").alias("publication_datetime"), created.alias("created_at"),
        F.col("s_name").alias("source"), F.when(F.col("l_suppkey") % 7 != 0, F.col("sn")).alias("source_country"), F.col("cn").alias("country"),
        F.when(F.col("suspect"), "suspect").otherwise("ok").alias("title_quality"), F.col("p_name").alias("title_original"),
        section.alias("primary_section"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("primary_topic"),
        F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type")).alias("feed_categories"),
        F.concat(F.lit("https://"), F.lower(F.regexp_replace("s_name", "#", "-")), F.lit(".example.com/"), F.lower("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "-")).alias("url"),
    )


ARTICLES = """articles AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS external_id, CASE WHEN l_linenumber <> 1 THEN 'st-' || l_orderkey END AS stable_id,
    TIMESTAMP '1998-06-01' + INTERVAL (l_orderkey % 720) HOUR AS publication_datetime,
    CASE WHEN l_linenumber = 7 THEN TIMESTAMP '1998-06-01' + INTERVAL (l_orderkey % 720 - 5) HOUR ELSE TIMESTAMP '1998-06-01' + INTERVAL (l_orderkey % 720 + l_suppkey % 72) HOUR END AS created_at,
    s_name AS source, CASE WHEN l_suppkey % 7 <> 0 THEN ns.n_name END AS source_country, nc.n_name AS country,
    CASE WHEN o_orderstatus = 'P' THEN 'suspect' ELSE 'ok' END AS title_quality, p_name AS title_original,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'politics' WHEN '2' THEN 'business' WHEN '3' THEN 'sports' WHEN '4' THEN 'others' ELSE 'world' END AS primary_section,
    CASE WHEN p_size % 5 <> 0 THEN p_type END AS primary_topic, CASE WHEN p_size % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_brand, p_type] END AS feed_categories,
    'https://' || lower(replace(s_name, '#', '-')) || '.example.com/' || lower(p_type) || '/' || replace(p_name, ' ', '-') AS url
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
    JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN part ON l_partkey = p_partkey)"""


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: a row for each outlet with its endpoints."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    has_map = key % 3 != 0
    name = F.lower(F.regexp_replace("s_name", "#", "-"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("country"), F.col("n_nationkey").cast("string").alias("code"), F.col("s_name").alias("source"), key.alias("outlet_id"),
        F.when((key % 2 == 0) | ~has_map, F.concat(F.lit("https://"), name, F.lit(".example.com/rss"))).alias("rss_url"),
        F.when(has_map, F.concat(F.lit("https://"), name, F.lit(".example.com/sitemap.xml"))).alias("sitemap_url"),
        (key % 17 != 0).alias("enabled"), F.when(key % 11 == 0, "portal").otherwise("publisher").alias("distribution_class"),
    )


FEEDS = """feeds AS (
  SELECT n_name AS country, CAST(n_nationkey AS VARCHAR) AS code, s_name AS source, s_suppkey AS outlet_id,
    CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN 'https://' || lower(replace(s_name, '#', '-')) || '.example.com/rss' END AS rss_url,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'https://' || lower(replace(s_name, '#', '-')) || '.example.com/sitemap.xml' END AS sitemap_url,
    s_suppkey % 17 <> 0 AS enabled, CASE WHEN s_suppkey % 11 = 0 THEN 'portal' ELSE 'publisher' END AS distribution_class
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of endpoint checks; a check that timed out has no status."""
    e, n = table(spark, sf_dir, "events"), table(spark, sf_dir, "nation")
    ok = F.col("event_type").isin("click", "view", "purchase")
    status = F.when(ok, F.lit(200)).otherwise(F.element_at(F.array(*(F.lit(x) for x in (403, 404, 500, 410))), (F.col("event_id") % 4 + 1).cast("int")))
    rows = e.join(n.select("n_nationkey", "n_name"), F.col("user_id") % 25 == F.col("n_nationkey")).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ran_at"), F.col("user_id").alias("outlet_id"), F.concat(F.lit("src-"), (F.col("user_id") % 50).cast("string")).alias("source"),
        F.when(F.col("event_id") % 3 == 0, "sitemap").otherwise("rss").alias("method"), F.col("n_name").alias("country"), (F.col("event_type") != "signup").alias("attempted"), ok.alias("ok"),
        F.get_json_object("props", "$.k").cast("int").alias("fetched_count"), F.when(ok | (F.col("event_id") % 10 != 7), status).alias("status_code"), (F.col("value") * 10).cast("int").alias("response_ms"),
        F.expr("cast(ts as timestamp_ntz) - make_dt_interval(0, cast(floor(value) as int))").alias("newest_item_published_at"),
    )
    return rows.withColumns({"error": F.when(~F.col("ok"), F.coalesce(F.concat(F.lit("http_"), F.col("status_code").cast("string")), F.lit("timed out"))), "url": F.concat(F.lit("https://src-"), (F.col("outlet_id") % 50).cast("string"), F.lit(".example.com/"), F.col("method"), F.lit("/"), (F.col("outlet_id") % 7).cast("string"))})


RUNS = """runs AS (
  SELECT *, CASE WHEN NOT ok THEN coalesce('http_' || status_code, 'timed out') END AS error, 'https://src-' || (outlet_id % 50) || '.example.com/' || method || '/' || (outlet_id % 7) AS url FROM (
  SELECT event_id AS id, ts AS ran_at, user_id AS outlet_id, 'src-' || (user_id % 50) AS source, CASE WHEN event_id % 3 = 0 THEN 'sitemap' ELSE 'rss' END AS method, n_name AS country,
    event_type <> 'signup' AS attempted, event_type IN ('click', 'view', 'purchase') AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) AS fetched_count,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 200 WHEN event_id % 10 <> 7 THEN [403, 404, 500, 410][event_id % 4 + 1] END AS status_code, CAST(trunc(value * 10) AS INTEGER) AS response_ms,
    ts - INTERVAL (CAST(floor(value) AS INTEGER)) HOUR AS newest_item_published_at
  FROM events JOIN nation ON user_id % 25 = n_nationkey))"""
