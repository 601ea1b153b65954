"""Queries of windowed counts: benchmark, map, dashboard and operations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.operators import benchmark, dashboard, mapview, ops
from coverline.plans.registry import query
from coverline.plans.views import ARTICLES, AS_OF, AT, FEEDS, RUNS, RUNS_AS_OF, RUNS_AT, articles, feeds, runs, table

DAY = datetime(1998, 6, 20)
BASE = f"WITH {ARTICLES}, {FEEDS}"


def _counts(start: str, end: str) -> str:
    return f"""kept AS (SELECT *, least(publication_datetime, created_at) AS pub FROM articles WHERE title_quality <> 'suspect'
    AND ((created_at >= {start} AND created_at < {end}) OR (publication_datetime >= {start} AND publication_datetime < {end}))),
a1 AS (SELECT source_country, source, count(*) FILTER (created_at >= {end} - INTERVAL 1 HOUR AND created_at < {end}) AS inserted_1h,
    count(*) FILTER (created_at >= {start} AND created_at < {end}) AS inserted, count(*) FILTER (pub >= {start} AND pub < {end}) AS published,
    count(*) FILTER (created_at >= {start} AND created_at < {end} AND pub >= {start} AND pub < {end}) AS fresh,
    count(*) FILTER (created_at >= {start} AND created_at < {end} AND pub < {start}) AS late FROM kept GROUP BY 1, 2)"""


PLACED = """per AS (SELECT coalesce(a1.source_country, f.country, '(unknown)') AS country, a1.source, CAST(sum(inserted_1h) AS BIGINT) AS inserted_1h, CAST(sum(inserted) AS BIGINT) AS inserted,
    CAST(sum(published) AS BIGINT) AS published, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(late) AS BIGINT) AS late
  FROM a1 LEFT JOIN (SELECT source, min(country) AS country FROM feeds GROUP BY 1) f ON f.source = a1.source GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY published DESC, source) AS k FROM per)"""


def _share(k: int) -> str:
    return f"CAST(CASE WHEN sum(published) > 0 THEN floor((2 * coalesce(sum(published) FILTER (k <= {k}), 0) * 10000 + sum(published)) / (2 * sum(published))) ELSE 0 END AS BIGINT) AS top{k}_share_bps"


def _sums(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


START, DSTART, DEND = "TIMESTAMP '1998-06-30'", "TIMESTAMP '1998-06-20'", "TIMESTAMP '1998-06-21'"
SHARES = ", ".join(_share(k) for k in (1, 5, 10))
ACTIVE = "count(*) FILTER (published > 0 OR inserted > 0) AS active_sources"
HOURLY = f"{BASE}, {_counts(START, AT)}, {PLACED}, a2 AS (SELECT country, {_sums('inserted_1h', 'inserted', 'published', 'fresh', 'late')}, {ACTIVE}, count(*) FILTER (inserted_1h > 0) AS active_sources_1h, {SHARES}, {AT} AS bucket FROM ranked GROUP BY country)"
DAILY = f"{BASE}, {_counts(DSTART, DEND)}, {PLACED}, a3 AS (SELECT country, {_sums('inserted', 'published', 'fresh', 'late')}, {ACTIVE}, {SHARES}, {DSTART} AS bucket FROM ranked GROUP BY country)"
DAYS_CTE = f"""rows AS (SELECT source_country, source, created_at, least(publication_datetime, created_at) AS pub FROM articles WHERE title_quality <> 'suspect'),
spread AS (SELECT *, date_trunc('day', created_at) AS bucket FROM rows UNION ALL SELECT *, date_trunc('day', pub) FROM rows WHERE date_trunc('day', pub) <> date_trunc('day', created_at)),
d AS (SELECT CAST(bucket AS TIMESTAMP) AS bucket, coalesce(s.source_country, f.country, '(unknown)') AS country, s.source, count(*) FILTER (date_trunc('day', created_at) = bucket) AS inserted, count(*) FILTER (date_trunc('day', pub) = bucket) AS published,
    count(*) FILTER (date_trunc('day', created_at) = bucket AND date_trunc('day', pub) = bucket) AS fresh, count(*) FILTER (date_trunc('day', created_at) = bucket AND pub < bucket) AS late
  FROM spread s LEFT JOIN (SELECT source, min(country) AS country FROM feeds GROUP BY 1) f ON f.source = s.source GROUP BY 1, 2, 3),
rankedd AS (SELECT *, row_number() OVER (PARTITION BY bucket, country ORDER BY published DESC, source) AS k FROM d),
days AS (SELECT bucket, country, {_sums('published', 'fresh', 'late', 'inserted')}, {ACTIVE}, {SHARES} FROM rankedd GROUP BY 1, 2)"""


@query("a1_source_window_counts", f"{BASE}, {_counts(START, AT)} SELECT * FROM a1")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.source_window_counts(articles(spark, d), datetime(1998, 6, 30), AS_OF)


@query("a2_country_benchmark_hourly", f"{HOURLY} SELECT * FROM a2")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.country_benchmark_hourly(articles(spark, d), feeds(spark, d), AS_OF)


@query("a3_country_benchmark_daily", f"{DAILY} SELECT * FROM a3")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.country_benchmark_daily(articles(spark, d), feeds(spark, d), DAY)


@query("a3_source_daily", f"{DAILY} SELECT country, source, inserted, published, fresh, late, {DSTART} AS bucket FROM per")
def a3s(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.source_daily(articles(spark, d), feeds(spark, d), DAY)


@query("a3_benchmark_days", f"{BASE}, {DAYS_CTE} SELECT * FROM days")
def a3d(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.benchmark_days(articles(spark, d), feeds(spark, d))


@query("a4_benchmark_latest", f"{BASE}, {DAYS_CTE}, v AS (SELECT *, CASE WHEN country < 'NATION_2' THEN 'v1' ELSE 'v2' END AS metric_version FROM days) SELECT metric_version, bucket, count(*) AS n_countries, CAST(sum(published) AS BIGINT) AS published FROM v WHERE bucket = (SELECT max(w.bucket) FROM v w WHERE w.metric_version = v.metric_version) GROUP BY 1, 2")
def a4(spark: SparkSession, d: str) -> DataFrame:
    days = benchmark.benchmark_days(articles(spark, d), feeds(spark, d))
    return benchmark.benchmark_latest(days.withColumn("metric_version", F.when(F.col("country") < "NATION_2", "v1").otherwise("v2")))


def _range_sql(period: str) -> str:
    weighted = ", ".join(f"CAST(CASE WHEN sum(published) > 0 THEN floor((2 * sum(top{k}_share_bps * published) + sum(published)) / (2 * sum(published))) ELSE 0 END AS BIGINT) AS top{k}_share_bps" for k in (1, 5, 10))
    return f"{BASE}, {DAYS_CTE} SELECT CAST({period} AS TIMESTAMP) AS period, country, {_sums('published', 'fresh', 'late', 'inserted')}, CAST(floor((2 * sum(active_sources) + count(*)) / (2 * count(*))) AS BIGINT) AS active_sources, {weighted}, count(*) AS n_days FROM days GROUP BY 1, 2"


@query("a5_benchmark_range_week", _range_sql("date_trunc('month', bucket) + INTERVAL 1 DAY * (7 * ((day(bucket) - 1) // 7))"))
def a5w(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.benchmark_range(benchmark.benchmark_days(articles(spark, d), feeds(spark, d)), "week")


@query("a5_benchmark_range_month", _range_sql("date_trunc('month', bucket)"))
def a5m(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.benchmark_range(benchmark.benchmark_days(articles(spark, d), feeds(spark, d)), "month")


PARTS = [f"{m}_{p}" for p in ("24h", "day", "week", "month") for m in ("published", "inserted")]


@query("a6_benchmark_wide", f"""{HOURLY}, {DAYS_CTE}, {', '.join(f"{name} AS (SELECT country, sum(published) AS published_{part}, sum(inserted) AS inserted_{part} FROM {rows} GROUP BY 1)" for name, part, rows in (('h', '24h', 'a2'), ('dd', 'day', f'days WHERE bucket = {DSTART}'), ('wk', 'week', f'days WHERE bucket > {DSTART} - INTERVAL 7 DAY AND bucket <= {DSTART}'), ('m', 'month', 'days')))},
k AS (SELECT country FROM h UNION SELECT country FROM dd UNION SELECT country FROM wk UNION SELECT country FROM m), w AS (SELECT k.country, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in PARTS)} FROM k LEFT JOIN h ON h.country = k.country LEFT JOIN dd ON dd.country = k.country LEFT JOIN wk ON wk.country = k.country LEFT JOIN m ON m.country = k.country)
SELECT w.country, c.code, w.* EXCLUDE (country) FROM w LEFT JOIN (SELECT country, min(code) AS code FROM feeds GROUP BY 1) c ON c.country = w.country
UNION ALL SELECT '(total)', NULL, {_sums(*PARTS)} FROM w""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    a, f = articles(spark, d), feeds(spark, d)
    days = benchmark.benchmark_days(a, f)
    day = F.lit("1998-06-20").cast("timestamp_ntz")
    week = days.where((F.col("bucket") > day - F.expr("INTERVAL '7' DAY")) & (F.col("bucket") <= day))
    return benchmark.benchmark_wide(benchmark.country_benchmark_hourly(a, f, AS_OF), days.where(F.col("bucket") == day), week, days, f)


@query("a7_benchmark_parity", f"""{DAILY}, {DAYS_CTE}, s AS (SELECT country, published, inserted, fresh, late FROM a3 WHERE country <> 'NATION_3'),
r AS (SELECT country, published, inserted + CASE WHEN country = 'NATION_4' THEN 1 ELSE 0 END AS inserted, fresh, late FROM days WHERE bucket = {DSTART})
SELECT coalesce(s.country, r.country) AS country, CASE WHEN s.country IS NULL THEN 'missing_in_stored' WHEN r.country IS NULL THEN 'missing_in_recomputed' ELSE 'mismatch' END AS kind, field,
  CASE field WHEN 'published' THEN s.published WHEN 'inserted' THEN s.inserted WHEN 'fresh' THEN s.fresh ELSE s.late END AS stored, CASE field WHEN 'published' THEN r.published WHEN 'inserted' THEN r.inserted WHEN 'fresh' THEN r.fresh ELSE r.late END AS recomputed
FROM s FULL JOIN r ON s.country = r.country, (VALUES ('published'), ('inserted'), ('fresh'), ('late')) x(field)
WHERE CASE field WHEN 'published' THEN s.published WHEN 'inserted' THEN s.inserted WHEN 'fresh' THEN s.fresh ELSE s.late END IS DISTINCT FROM CASE field WHEN 'published' THEN r.published WHEN 'inserted' THEN r.inserted WHEN 'fresh' THEN r.fresh ELSE r.late END""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    a, f = articles(spark, d), feeds(spark, d)
    fields = ["published", "inserted", "fresh", "late"]
    stored = benchmark.country_benchmark_daily(a, f, DAY).where("country <> 'NATION_3'")
    again = benchmark.benchmark_days(a, f).where(F.col("bucket") == F.lit("1998-06-20").cast("timestamp_ntz"))
    return benchmark.benchmark_parity(stored, again.withColumn("inserted", F.col("inserted") + F.when(F.col("country") == "NATION_4", 1).otherwise(0)), ["country"], fields)


def _metric(m: str, hours: int, name: str) -> str:
    p, c = f"publication_datetime >= {AT} - INTERVAL {hours} HOUR", f"created_at >= {AT} - INTERVAL {hours} HOUR"
    return f"count(*) FILTER ({ {'pub': p, 'fresh': f'{p} AND {c}', 'late': f'{c} AND NOT {p}', 'first_seen': c}[m] }) AS {m}_{name}"


METRICS = ", ".join(_metric(m, h, w) for w, h in (("1h", 1), ("24h", 24), ("7d", 168)) for m in mapview.METRICS)
NAMES = [f"{m}_{w}" for w in mapview.WINDOWS for m in mapview.METRICS]
A8 = f"""a8 AS (SELECT source_country, country AS article_country, source, {METRICS}, coalesce(source_country, country) AS country FROM articles
  WHERE title_quality <> 'suspect' AND (publication_datetime >= {AT} - INTERVAL 168 HOUR OR created_at >= {AT} - INTERVAL 168 HOUR) GROUP BY source_country, articles.country, source)"""
HEALTH = "health AS (SELECT source, CASE WHEN s_suppkey % 5 = 0 THEN 'failing' WHEN s_suppkey % 5 = 1 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT s_name AS source, s_suppkey FROM supplier))"


def _health(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    return table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.when(k == 0, "failing").when(k == 1, "degraded").otherwise("healthy").alias("health"))


@query("a8_map_source_metrics", f"{BASE}, {A8} SELECT * FROM a8")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return mapview.map_source_metrics(articles(spark, d), AS_OF)


@query("a8_map_source_metrics_1h", f"{BASE}, {A8} SELECT source_country, article_country, source, country, pub_1h, fresh_1h, late_1h, first_seen_1h, {', '.join(f'CAST(0 AS BIGINT) AS {n}' for n in NAMES[4:])} FROM a8 WHERE pub_1h > 0 OR first_seen_1h > 0")
def a8h(spark: SparkSession, d: str) -> DataFrame:
    return mapview.map_source_metrics(articles(spark, d), AS_OF, "1h")


#: Publisher and region of a source of the view; some have neither.
PLACED_SOURCES = "pb AS (SELECT s_name AS source, 'Group ' || (s_suppkey % 4) AS publisher FROM supplier WHERE s_suppkey % 3 > 0), pl AS (SELECT s_name AS source, CASE WHEN s_suppkey % 7 = 0 THEN 'Foreign-operated' ELSE 'Area ' || (s_suppkey % 5) END AS region FROM supplier WHERE s_suppkey % 4 > 0)"
METHODS = """mt AS (SELECT country, source, CASE WHEN bool_or(rss_url IS NOT NULL) AND bool_or(sitemap_url IS NOT NULL) THEN 'rss+sitemap' WHEN bool_or(rss_url IS NOT NULL) THEN 'rss' WHEN bool_or(sitemap_url IS NOT NULL) THEN 'sitemap' END AS method,
  min(CASE WHEN distribution_class = 'portal' THEN 'portal' WHEN rss_url IS NOT NULL AND sitemap_url IS NOT NULL THEN 'rss_and_sitemap' WHEN rss_url IS NOT NULL THEN 'rss_only' WHEN sitemap_url IS NOT NULL THEN 'sitemap_only' ELSE 'none' END) AS profile FROM feeds WHERE enabled GROUP BY 1, 2)"""
COUNTED = ("active_sources", "rss_sources", "sitemap_sources", "healthy_sources", "degraded_sources", "configured_sources", "rss_only", "sitemap_only", "rss_and_sitemap", "checked_sources")


def _publishers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_name").alias("source"), F.concat(F.lit("Group "), (F.col("s_suppkey") % 4).cast("string")).alias("publisher"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").where(k % 4 > 0).select(F.col("s_name").alias("source"), F.when(k % 7 == 0, mapview.FOREIGN).otherwise(F.concat(F.lit("Area "), (k % 5).cast("string"))).alias("region"))


@query("a9_map_country_metrics", f"""{BASE}, {A8}, {HEALTH}, {PLACED_SOURCES}, {METHODS},
p AS (SELECT country, source, {_sums(*NAMES)} FROM a8 GROUP BY 1, 2), q AS (SELECT p.*, health, method, coalesce(publisher, p.source) AS publisher FROM p LEFT JOIN health ON health.source = p.source LEFT JOIN mt ON mt.country = p.country AND mt.source = p.source LEFT JOIN pb ON pb.source = p.source),
t AS (SELECT country, {_sums(*NAMES)}, count(*) FILTER (pub_24h > 0) AS active_sources, count(*) FILTER (pub_24h > 0 AND contains(method, 'rss')) AS rss_sources, count(*) FILTER (pub_24h > 0 AND contains(method, 'sitemap')) AS sitemap_sources, count(*) FILTER (health = 'healthy') AS healthy_sources, count(*) FILTER (health IN ('degraded', 'failing')) AS degraded_sources FROM q GROUP BY 1),
e AS (SELECT country, count(DISTINCT source) AS configured_sources, count(*) FILTER (rss_url IS NOT NULL AND sitemap_url IS NULL) AS rss_only, count(*) FILTER (rss_url IS NULL AND sitemap_url IS NOT NULL) AS sitemap_only, count(*) FILTER (rss_url IS NOT NULL AND sitemap_url IS NOT NULL) AS rss_and_sitemap FROM feeds WHERE enabled AND distribution_class <> 'portal' GROUP BY 1),
c AS (SELECT country, count(DISTINCT source) AS checked_sources FROM feeds WHERE outlet_id % 2 = 0 GROUP BY 1), u AS (SELECT t.country, {', '.join(NAMES)}, {', '.join(f'coalesce({x}, 0) AS {x}' for x in COUNTED)} FROM t LEFT JOIN e ON e.country = t.country LEFT JOIN c ON c.country = t.country),
v AS (SELECT * FROM u UNION ALL SELECT '(total)', {_sums(*NAMES, *COUNTED)} FROM u), sr AS (SELECT country, source AS name, row_number() OVER (PARTITION BY country ORDER BY sum(pub_24h) DESC, source) AS k FROM q GROUP BY 1, 2 HAVING sum(pub_24h) > 0), pr AS (SELECT country, publisher AS name, row_number() OVER (PARTITION BY country ORDER BY sum(pub_24h) DESC, publisher) AS k FROM q GROUP BY 1, 2 HAVING sum(pub_24h) > 0),
st AS (SELECT country, string_agg(name, '|' ORDER BY k) AS top_sources FROM sr WHERE k <= 3 GROUP BY 1), pt AS (SELECT country, string_agg(name, '|' ORDER BY k) AS top_publishers FROM pr WHERE k <= 3 GROUP BY 1)
SELECT v.*, coalesce(top_sources, '') AS top_sources, coalesce(top_publishers, '') AS top_publishers, CAST(CASE WHEN first_seen_24h > 0 THEN floor((2 * late_24h * 100 + first_seen_24h) / (2 * first_seen_24h)) ELSE 0 END AS BIGINT) AS late_share FROM v LEFT JOIN st ON st.country = v.country LEFT JOIN pt ON pt.country = v.country""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    f = feeds(spark, d)
    return mapview.map_country_metrics(mapview.map_source_metrics(articles(spark, d), AS_OF), _health(spark, d), f, f.where("outlet_id % 2 = 0").select("country", "source"), _publishers(spark, d))


PUBLISHERS = "publishers AS (SELECT s_name AS source, 'group-' || (s_suppkey % 9) AS publisher, CAST(1 + s_suppkey % 3 AS INTEGER) AS score FROM supplier)"


@query("a10_map_publishers", f"""{BASE}, {A8}, {PUBLISHERS},
p AS (SELECT publisher, country, sum(pub_24h) AS pub_24h, sum(first_seen_24h) AS first_seen_24h, sum(late_24h) AS late_24h, count(DISTINCT a8.source) FILTER (pub_24h > 0) AS active, sum(score) AS score, count(*) AS n FROM a8 JOIN publishers ON publishers.source = a8.source GROUP BY 1, 2)
SELECT publisher, {_sums('pub_24h', 'first_seen_24h', 'late_24h')}, count(*) FILTER (pub_24h > 0) AS active_countries, CAST(sum(active) AS BIGINT) AS active_sources, CASE WHEN sum(score) / sum(n) >= 2.6 THEN 'high' WHEN sum(score) / sum(n) >= 1.6 THEN 'medium' ELSE 'low' END AS confidence,
  string_agg(country || ':' || pub_24h, '|' ORDER BY pub_24h DESC, country) AS countries FROM p GROUP BY 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    named = table(spark, d, "supplier").select(F.col("s_name").alias("source"), F.concat(F.lit("group-"), (k % 9).cast("string")).alias("publisher"), (1 + k % 3).cast("int").alias("score"))
    return mapview.map_publishers(mapview.map_source_metrics(articles(spark, d), AS_OF), named)


M24 = [f"{m}_24h" for m in mapview.METRICS]


@query("a11_map_country_sources", f"""{BASE}, {A8}, {HEALTH}, {PLACED_SOURCES}, {METHODS}, p AS (SELECT country, source, {_sums(*M24)} FROM a8 GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(health, 'unknown') AS health, method, profile, coalesce(publisher, p.source) AS publisher, coalesce(region, 'Unmapped / National') AS region FROM p LEFT JOIN health ON health.source = p.source LEFT JOIN mt ON mt.country = p.country AND mt.source = p.source LEFT JOIN pb ON pb.source = p.source LEFT JOIN pl ON pl.source = p.source),
gp AS (SELECT country, publisher, {_sums(*M24)}, count(*) AS n_sources FROM q GROUP BY 1, 2), gr AS (SELECT country, region, {_sums(*M24)}, count(*) AS n_sources FROM q GROUP BY 1, 2),
r AS (SELECT country, 'source' AS kind, source AS name, {', '.join(M24)}, CAST(1 AS BIGINT) AS n_sources, row_number() OVER (PARTITION BY country ORDER BY pub_24h DESC, first_seen_24h DESC, source) AS rank, health, method, profile, publisher FROM q
  UNION ALL SELECT country, 'publisher', publisher, {', '.join(M24)}, n_sources, row_number() OVER (PARTITION BY country ORDER BY pub_24h DESC, publisher), NULL, NULL, NULL, NULL FROM gp
  UNION ALL SELECT country, 'region', region, {', '.join(M24)}, n_sources, row_number() OVER (PARTITION BY country ORDER BY region IN ('Unmapped / National', 'Foreign-operated'), pub_24h DESC, n_sources DESC, region), NULL, NULL, NULL, NULL FROM gr)
SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM r WHERE rank <= 8""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return mapview.map_country_sources(mapview.map_source_metrics(articles(spark, d), AS_OF), _health(spark, d), feeds(spark, d), _publishers(spark, d), _places(spark, d))


@query("a12_source_detail", f"""WITH {ARTICLES}, {RUNS},
a AS (SELECT CASE WHEN true THEN 'src-' || (CAST(right(source, 9) AS BIGINT) % 60) END AS source, count(*) FILTER (publication_datetime >= {AT} - INTERVAL 24 HOUR) AS pub_24h, count(*) FILTER (created_at >= {AT} - INTERVAL 24 HOUR) AS first_seen_24h, max(publication_datetime) AS last_publication FROM articles GROUP BY 1),
hh AS (SELECT 'src-' || (CAST(right(source, 9) AS BIGINT) % 60) AS source, CAST(date_diff('hour', {AT} - INTERVAL 24 HOUR, publication_datetime) AS INTEGER) AS h, count(*) AS n FROM articles WHERE publication_datetime >= {AT} - INTERVAL 24 HOUR AND publication_datetime < {AT} GROUP BY 1, 2),
sl AS (SELECT k.source, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY i) AS hourly FROM (SELECT source FROM a UNION SELECT source FROM runs) k CROSS JOIN range(24) g(i) LEFT JOIN hh ON hh.source = k.source AND hh.h = i GROUP BY 1),
r AS (SELECT source, count(*) FILTER (attempted AND ran_at >= {RUNS_AT} - INTERVAL 24 HOUR) AS attempts_24h, count(*) FILTER (attempted AND NOT ok AND ran_at >= {RUNS_AT} - INTERVAL 24 HOUR) AS failures_24h, arg_max(error, (ran_at, id)) FILTER (NOT ok) AS last_error FROM runs GROUP BY 1)
SELECT coalesce(a.source, r.source) AS source, coalesce(pub_24h, 0) AS pub_24h, coalesce(first_seen_24h, 0) AS first_seen_24h, coalesce(attempts_24h, 0) AS attempts_24h, coalesce(failures_24h, 0) AS failures_24h, last_publication, last_error,
  CAST(CASE WHEN attempts_24h > 0 THEN floor((2 * failures_24h * 100 + attempts_24h) / (2 * attempts_24h)) ELSE 0 END AS BIGINT) AS failure_pct, hourly FROM a FULL JOIN r ON a.source = r.source LEFT JOIN sl ON sl.source = coalesce(a.source, r.source)""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    renamed = articles(spark, d).withColumn("source", F.concat(F.lit("src-"), (F.substring("source", -9, 9).cast("long") % 60).cast("string")))
    return mapview.source_detail(renamed, runs(spark, d), AS_OF, RUNS_AS_OF)


@query("a13_hourly_series", f"WITH {ARTICLES} SELECT country, CAST(date_trunc('hour', publication_datetime) AS TIMESTAMP) AS hour, count(*) AS n FROM articles WHERE publication_datetime >= {AT} - INTERVAL 24 HOUR AND publication_datetime < {AT} GROUP BY 1, 2")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return mapview.hourly_series(articles(spark, d), "country", AS_OF)


@query("a13_daily_series", f"{BASE}, {DAYS_CTE} SELECT country, bucket, published, inserted FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY bucket DESC) AS k FROM days) WHERE k <= 7")
def a13d(spark: SparkSession, d: str) -> DataFrame:
    return mapview.daily_series(benchmark.benchmark_days(articles(spark, d), feeds(spark, d)), "country")


@query("a14_checked_sources", f"WITH {RUNS}, {FEEDS} SELECT DISTINCT country, source FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 48 HOUR AND outlet_id IN (SELECT outlet_id FROM feeds WHERE enabled)")
def a14(spark: SparkSession, d: str) -> DataFrame:
    named = runs(spark, d).withColumn("runner", F.lit("worker"))  # the log is the worker's own
    return mapview.checked_sources(named, RUNS_AS_OF, 48, feeds(spark, d), "worker")


RECENT = f"created_at >= {AT} - INTERVAL 31 DAY"


@query("a15_dashboard_totals", f"WITH {ARTICLES} SELECT count(*) AS n_articles, count(*) FILTER (created_at >= {AT} - INTERVAL 24 HOUR) AS inserted, count(*) FILTER (publication_datetime >= {AT} - INTERVAL 24 HOUR) AS published, {AT} AS generated_at FROM articles WHERE {RECENT}")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.dashboard_totals(articles(spark, d), AS_OF)


@query("a16_dashboard_sections", f"WITH {ARTICLES} SELECT coalesce(primary_section, 'others') AS section, count(*) AS n_articles FROM articles WHERE {RECENT} GROUP BY 1")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.dashboard_sections(articles(spark, d), AS_OF)


@query("a17_dashboard_topics", f"""WITH {ARTICLES}, c AS (SELECT primary_section AS section, primary_topic AS topic, count(*) AS n FROM articles WHERE {RECENT} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, topic) AS k FROM c WHERE topic IS NOT NULL), t AS (SELECT section, string_agg(topic || ':' || n, '|' ORDER BY k) AS top_topics FROM r WHERE k <= 3 GROUP BY 1)
SELECT c.section, CAST(sum(n) AS BIGINT) AS n_articles, CAST(coalesce(sum(n) FILTER (topic IS NULL), 0) AS BIGINT) AS unassigned, any_value(top_topics) AS top_topics, CASE c.section WHEN 'world' THEN 1 WHEN 'politics' THEN 2 WHEN 'business' THEN 4 WHEN 'sports' THEN 6 ELSE 13 END AS section_rank FROM c LEFT JOIN t ON t.section = c.section GROUP BY c.section""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.dashboard_topics(articles(spark, d), AS_OF).withColumn("section_rank", F.col("section_rank").cast("int"))


@query("a18_category_totals", f"WITH {ARTICLES}, u AS (SELECT unnest(feed_categories) AS category FROM articles) SELECT count(*) FILTER (len(feed_categories) > 0) AS categorised, count(*) FILTER (len(feed_categories) = 0) AS uncategorised, (SELECT count(DISTINCT category) FROM u) AS n_categories FROM articles")
def a18t(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.category_coverage(articles(spark, d))[0]


@query("a18_top_categories", f"WITH {ARTICLES}, u AS (SELECT unnest(feed_categories) AS category FROM articles) SELECT category, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.category_coverage(articles(spark, d))[1]


@query("a19_recent_dates", f"WITH {ARTICLES}, x AS (SELECT CAST(publication_datetime AS DATE) AS day, count(*) AS n FROM articles GROUP BY 1 ORDER BY 1 DESC LIMIT 7) SELECT day, n, day = (SELECT coalesce(max(day) FILTER (day < DATE '1998-06-29'), max(day)) FROM x) AS preview FROM x")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.recent_dates(articles(spark, d), datetime(1998, 6, 29, 12))


DIRECT = "source NOT IN (SELECT source FROM feeds WHERE distribution_class = 'portal')"


@query("a20_preview", f"{BASE} SELECT country, count(*) AS n FROM articles WHERE publication_datetime >= {AT} - INTERVAL 24 HOUR AND {DIRECT} GROUP BY 1 ORDER BY n DESC, country LIMIT 10")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.preview(articles(spark, d), feeds(spark, d), AS_OF)


@query("a20_preview_headlines", f"{BASE} SELECT external_id, source, title_original, publication_datetime FROM articles WHERE title_quality <> 'suspect' AND publication_datetime < {AT} AND {DIRECT} ORDER BY publication_datetime DESC, created_at DESC, external_id LIMIT 20")
def a20h(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.preview_headlines(articles(spark, d), feeds(spark, d), AS_OF)


P24, C24 = f"publication_datetime >= {AT} - INTERVAL 24 HOUR", f"created_at >= {AT} - INTERVAL 24 HOUR"


@query("a21_country_report", f"""{BASE}, k AS (SELECT source, max(CASE WHEN distribution_class = 'portal' THEN 1 ELSE 0 END) AS portal FROM feeds GROUP BY 1),
x AS (SELECT a.*, portal FROM articles a LEFT JOIN k ON k.source = a.source WHERE title_quality <> 'suspect' AND ({P24} OR {C24})),
s AS (SELECT 'publisher' AS view, source_country AS place, * FROM x WHERE source_country IS NOT NULL UNION ALL SELECT 'coverage', country, * FROM x),
c AS (SELECT view, place, count(*) FILTER ({P24} AND portal = 0) AS core_published, count(*) FILTER ({P24} AND portal = 1) AS portal_published, count(*) FILTER ({P24}) AS published, count(*) FILTER (created_at >= {AT} - INTERVAL 1 HOUR) AS inserted_1h, count(*) FILTER ({C24}) AS inserted, count(*) FILTER ({C24} AND {P24}) AS fresh, count(*) FILTER ({C24} AND NOT {P24}) AS late FROM s GROUP BY 1, 2),
w AS (SELECT DISTINCT country, v.view FROM feeds, (VALUES ('publisher'), ('coverage')) v(view))
SELECT w.country, w.view, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('core_published', 'portal_published', 'published', 'inserted_1h', 'inserted', 'fresh', 'late'))}, CAST(CASE WHEN inserted > 0 THEN floor((2 * late * 100 + inserted) / (2 * inserted)) ELSE 0 END AS BIGINT) AS late_share FROM w LEFT JOIN c ON c.place = w.country AND c.view = w.view""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.country_report(articles(spark, d), feeds(spark, d), AS_OF)


@query("a22_recent_counts", f"WITH {ARTICLES} SELECT source, source_country, count(*) AS n FROM articles WHERE {C24} GROUP BY 1, 2 ORDER BY n DESC, source, source_country LIMIT 50")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.recent_counts(articles(spark, d), AS_OF)


@query("a22_recent_country_counts", f"WITH {ARTICLES} SELECT country, count(*) FILTER (created_at >= {AT} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER ({C24}) AS n_24h FROM articles GROUP BY 1")
def a22c(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.recent_country_counts(articles(spark, d), AS_OF)


@query("a23_configured_coverage", f"""WITH {FEEDS}, e AS (SELECT country, source, enabled, distribution_class, 'rss' AS type, rss_url AS url FROM feeds WHERE rss_url IS NOT NULL UNION ALL SELECT country, source, enabled, distribution_class, 'sitemap', sitemap_url FROM feeds WHERE sitemap_url IS NOT NULL)
SELECT country, count(*) AS registrations, count(*) FILTER (enabled) AS active, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (distribution_class <> 'portal') AS direct_sources, count(DISTINCT url) FILTER (type = 'rss') AS rss_endpoints, count(DISTINCT url) FILTER (type = 'sitemap') AS sitemap_endpoints FROM e GROUP BY ROLLUP (country)""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.configured_coverage(feeds(spark, d))


AUDITED = "n, n_others, n_empty, n_both, n_recoverable, others_pct, empty_pct, both_pct, recoverable_pct"


def _audit_list(name: str, level: int, size: str, least: int, by: str) -> str:
    order = f"n_{by} DESC, {by}_pct DESC, n DESC, coalesce(country, ''), coalesce(source, '')"
    return f"SELECT * FROM (SELECT '{name}' AS list, row_number() OVER (ORDER BY {order}) AS rank, country, source, {AUDITED} FROM s WHERE level = {level} AND {size} >= {least}) WHERE rank <= 15"


def _pct(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN floor((2 * {part} * 100 + {whole}) / (2 * ({whole}))) ELSE 0 END AS BIGINT)"


@query("a24_taxonomy_audit", f"""WITH {ARTICLES}, x AS (SELECT country, source, primary_section = 'others' AS o, len(feed_categories) = 0 AS e FROM articles WHERE created_at >= {AT} - INTERVAL 168 HOUR),
g AS (SELECT country, source, grouping(country, source) AS level, count(*) AS n, count(*) FILTER (o) AS n_others, count(*) FILTER (e) AS n_empty, count(*) FILTER (o AND e) AS n_both, count(*) FILTER (o AND NOT e) AS n_recoverable FROM x GROUP BY GROUPING SETS ((), (country), (country, source))),
s AS (SELECT *, n - n_empty AS filled, {_pct('n_others', 'n')} AS others_pct, {_pct('n_empty', 'n')} AS empty_pct, {_pct('n_both', 'n')} AS both_pct, {_pct('n_recoverable', '(n - n_empty)')} AS recoverable_pct FROM g)
SELECT 'total' AS list, CAST(1 AS BIGINT) AS rank, country, source, {AUDITED} FROM s WHERE level = 3 UNION ALL {_audit_list('countries', 1, 'n', 50, 'others')} UNION ALL {_audit_list('missing_signal', 0, 'n', 5, 'both')} UNION ALL {_audit_list('recoverable', 0, 'filled', 4, 'recoverable')}""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.taxonomy_audit(articles(spark, d), AS_OF, least_source=5, least_recoverable=4)


@query("a25_unmapped_categories", f"""WITH {ARTICLES}, u AS (SELECT source, unnest(feed_categories) AS category FROM articles WHERE primary_section = 'others'), p AS (SELECT category, source, count(*) AS n FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, source) AS k FROM p)
SELECT category, CAST(sum(n) AS BIGINT) AS n_articles, count(*) AS n_sources, string_agg(source, ', ' ORDER BY k) FILTER (k <= 3) AS sample_sources FROM r GROUP BY 1""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.unmapped_categories(articles(spark, d))


@query("a26_others_audit", f"""WITH {ARTICLES}, x AS (SELECT *, CASE WHEN len(feed_categories) = 0 THEN NULL ELSE primary_topic END AS label, length(title_original) / 20.0 AS score FROM articles WHERE primary_section = 'others'),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, external_id, title_original) AS k FROM x WHERE label IS NOT NULL),
ts AS (SELECT label, source AS name, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, source) AS k FROM r GROUP BY 1, 2), tc AS (SELECT label, name, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, name) AS k FROM (SELECT label, unnest(feed_categories) AS name FROM r) GROUP BY 1, 2),
sp AS (SELECT label, string_agg(name || ':' || n, '|' ORDER BY k) AS top_sources FROM ts WHERE k <= 3 GROUP BY 1), cp AS (SELECT label, string_agg(name || ':' || n, '|' ORDER BY k) AS top_categories FROM tc WHERE k <= 3 GROUP BY 1),
o AS (SELECT label, count(*) AS n_articles, CAST(floor(avg(score) * 100 + 0.5) AS BIGINT) AS mean_score, count(DISTINCT source) AS n_sources, string_agg(title_original, '|' ORDER BY k) FILTER (k <= 2) AS sample_titles FROM r GROUP BY 1)
SELECT o.label AS candidate, o.* EXCLUDE (label), top_sources, top_categories FROM o LEFT JOIN sp ON sp.label = o.label LEFT JOIN cp ON cp.label = o.label""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    other = F.struct(F.lit("others").alias("label"), F.lit(0.99).alias("score"))
    best = F.struct(F.col("primary_topic").alias("label"), (F.length("title_original") / F.lit(20.0)).alias("score"))
    a = articles(spark, d).withColumn("section_candidates", F.when((F.size("feed_categories") == 0) | F.col("primary_topic").isNull(), F.array(other)).otherwise(F.array(other, best)))
    return dashboard.others_audit(a)


@query("a27_topic_audit", f"""WITH {ARTICLES}, t AS (SELECT primary_section AS section, count(*) AS total FROM articles GROUP BY 1),
x AS (SELECT primary_section AS section, 'topic' AS kind, coalesce(primary_topic, '(empty)') AS name, count(*) AS n FROM articles GROUP BY 1, 3
  UNION ALL SELECT section, 'unassigned_category', c, count(*) FROM (SELECT primary_section AS section, unnest(CASE WHEN len(feed_categories) = 0 THEN ['(empty)'] ELSE feed_categories END) AS c FROM articles WHERE primary_topic IS NULL) GROUP BY 1, 3
  UNION ALL SELECT primary_section, 'unassigned_source', source, count(*) FROM articles WHERE primary_topic IS NULL GROUP BY 1, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY section, kind ORDER BY n DESC, name) AS k FROM x), g AS (SELECT section, kind, CAST(CASE WHEN k > 12 THEN 13 ELSE k END AS INTEGER) AS rank, CASE WHEN k > 12 THEN '(hidden)' ELSE name END AS name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_names FROM r GROUP BY 1, 2, 3, 4)
SELECT g.*, {_pct('n', 'total')} AS pct FROM g JOIN t ON t.section = g.section""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.topic_audit(articles(spark, d))


@query("a28_ops_summary", f"""WITH {ARTICLES}, {RUNS}, a AS (SELECT 'src-' || (CAST(right(source, 9) AS BIGINT) % 60) AS source, count(*) AS n_articles FROM articles WHERE {C24} GROUP BY 1),
r AS (SELECT source, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 24 HOUR GROUP BY 1),
b AS (SELECT coalesce(a.source, r.source) AS source, coalesce(n_articles, 0) AS n_articles, coalesce(attempts, 0) AS attempts, coalesce(failures, 0) AS failures FROM a FULL JOIN r ON a.source = r.source)
SELECT *, CAST(CASE WHEN attempts > 0 THEN floor((2 * failures * 100 + attempts) / (2 * attempts)) ELSE 0 END AS BIGINT) AS failure_pct FROM b ORDER BY n_articles DESC, failures DESC, source LIMIT 25""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    renamed = articles(spark, d).withColumn("source", F.concat(F.lit("src-"), (F.substring("source", -9, 9).cast("long") % 60).cast("string")))
    return ops.ops_summary(renamed, runs(spark, d), AS_OF, RUNS_AS_OF)


ROLLUP = "SELECT CAST(date_trunc('{}', ran_at) AS TIMESTAMP) AS bucket, outlet_id, method, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, CAST(sum(fetched_count) AS BIGINT) AS fetched, CAST(sum(response_ms) AS BIGINT) AS response_ms FROM runs WHERE attempted GROUP BY 1, 2, 3"
PCT = "CAST(CASE WHEN sum(attempts) > 0 THEN floor((2 * sum(failures) * 100 + sum(attempts)) / (2 * sum(attempts))) ELSE 0 END AS BIGINT) AS failure_pct"
for _unit in ("hour", "day"):
    query(f"a29_ops_rollup_{_unit}", f"WITH {RUNS} {ROLLUP.format(_unit)}")(lambda spark, d, unit=_unit: ops.ops_rollup(runs(spark, d), unit))


@query("a29_ops_report", f"WITH {RUNS}, o AS ({ROLLUP.format('day')}), c AS (SELECT outlet_id, min(country) AS country FROM runs GROUP BY 1) SELECT method, country, grouping(method, country) AS level, {_sums('attempts', 'successes', 'failures', 'fetched')}, {PCT} FROM o LEFT JOIN c ON c.outlet_id = o.outlet_id GROUP BY GROUPING SETS ((), (method), (country))")
def a29(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return ops.ops_report(ops.ops_rollup(r, "day"), r.groupBy("outlet_id").agg(F.min("country").alias("country")))


@query("a29_weekly_report", f"""WITH {RUNS}, o AS (SELECT * FROM ({ROLLUP.format('day')}) WHERE bucket >= {RUNS_AT} - INTERVAL 7 DAY AND bucket < {RUNS_AT}), c AS (SELECT outlet_id, min(country) AS country FROM runs GROUP BY 1), w AS (SELECT o.*, coalesce(country, '(unknown)') AS country FROM o LEFT JOIN c ON c.outlet_id = o.outlet_id), fl AS (SELECT * FROM runs WHERE attempted AND NOT ok AND ran_at >= {RUNS_AT} - INTERVAL 7 DAY AND ran_at < {RUNS_AT}),
k AS (SELECT 'country' AS part, country AS key, sum(attempts) AS attempts, sum(failures) AS failures FROM w GROUP BY 2 UNION ALL SELECT 'feed', outlet_id || '/' || method, sum(attempts), sum(failures) FROM w GROUP BY 2 UNION ALL SELECT 'reason', method || ':' || coalesce(error, 'unknown'), (SELECT count(*) FROM fl), count(*) FROM fl GROUP BY 2),
r AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY failures DESC, attempts DESC, key) AS INTEGER) AS place, key, attempts, failures FROM k),
t AS (SELECT 'total' AS part, 1 AS place, CASE WHEN sum(failures) > 0 THEN 'degraded' ELSE 'healthy' END AS key, sum(attempts) AS attempts, sum(failures) AS failures FROM w UNION ALL SELECT 'method', CASE method WHEN 'rss' THEN 1 ELSE 2 END, method, sum(attempts), sum(failures) FROM w GROUP BY 3, 2 UNION ALL SELECT * FROM r WHERE place <= 10)
SELECT part, place, key, CAST(attempts AS BIGINT) AS attempts, CAST(failures AS BIGINT) AS failures, CAST(CASE WHEN attempts > 0 THEN floor((2 * failures * 100 + attempts) / (2 * attempts)) ELSE 0 END AS BIGINT) AS failure_pct FROM t""")
def a29w(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return ops.weekly_report(r, r.groupBy("outlet_id").agg(F.min("country").alias("country")), RUNS_AS_OF)


@query("a29_top_failing", f"WITH {RUNS}, o AS ({ROLLUP.format('day')}) SELECT outlet_id, method, {_sums('attempts', 'failures')}, {PCT} FROM o GROUP BY 1, 2 ORDER BY failures DESC, failure_pct DESC, outlet_id, method LIMIT 10")
def a29t(spark: SparkSession, d: str) -> DataFrame:
    return ops.top_failing(ops.ops_rollup(runs(spark, d), "day"))


REASONS = "CASE id % 7 WHEN 0 THEN 'primary_invalid' WHEN 1 THEN 'network_error: reset' WHEN 2 THEN 'sitemap_policy_disabled' WHEN 3 THEN 'html_returned' ELSE error END"


@query("a30_failure_reasons", f"""WITH {RUNS}, f AS (SELECT method, {REASONS} AS error FROM runs WHERE attempted AND NOT ok AND method = 'sitemap' AND outlet_id IN ({', '.join(map(str, range(0, 150, 2)))}) AND ran_at >= {RUNS_AT} - INTERVAL 168 HOUR),
p AS (SELECT method || ':' || coalesce(error, 'unknown') AS reason, count(*) AS n, CASE coalesce(error, 'unknown') WHEN 'primary_invalid' THEN 0 WHEN 'html_returned' THEN 1 WHEN 'network_error: reset' THEN 2 WHEN 'sitemap_policy_disabled' THEN 4 ELSE 3 END AS priority FROM f GROUP BY ALL)
SELECT *, CAST(row_number() OVER (ORDER BY priority, n DESC, reason) AS INTEGER) AS place FROM p""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 7
    error = F.when(k == 0, "primary_invalid").when(k == 1, "network_error: reset").when(k == 2, "sitemap_policy_disabled").when(k == 3, "html_returned").otherwise(F.col("error"))
    return ops.failure_reasons(runs(spark, d).withColumn("error", error), RUNS_AS_OF, 168, method="sitemap", outlets=tuple(range(0, 150, 2)), weekly=True)


@query("a31_ops_table", f"WITH {RUNS}, o AS (SELECT * FROM ({ROLLUP.format('hour')}) WHERE contains(method, 'sitemap') OR contains(CAST(outlet_id AS VARCHAR), 'sitemap')) SELECT *, (SELECT count(*) FROM o) AS total_count, (SELECT max(bucket) FROM o) AS last_updated FROM o ORDER BY failures DESC, bucket DESC, outlet_id, method LIMIT 25 OFFSET 50")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return ops.paged(ops.ops_rollup(runs(spark, d), "hour"), [F.desc("failures"), F.desc("bucket"), F.col("outlet_id"), F.col("method")], 2, 25, "bucket", "SiteMap", ("method", "outlet_id"))


@query("a31_feed_lag", f"WITH {RUNS}, x AS (SELECT outlet_id, method, max(newest_item_published_at) FILTER (ok) AS last_publication, max(ran_at) AS last_fetched FROM runs GROUP BY 1, 2) SELECT *, CAST(floor((epoch({RUNS_AT}) - floor(epoch(coalesce(last_publication, last_fetched)))) / 3600) AS BIGINT) AS lag_hours FROM x")
def a31l(spark: SparkSession, d: str) -> DataFrame:
    return ops.feed_lag(runs(spark, d), RUNS_AS_OF)


MENTIONS = "mentions AS (SELECT external_id AS article_external_id, ['team', 'person', 'competition', 'venue'][CAST(length(title_original) % 4 + 1 AS INTEGER)] AS entity_type FROM articles WHERE length(title_original) % 3 > 0 UNION ALL SELECT external_id, 'team' FROM articles WHERE length(source || title_original) % 5 = 0)"


@query("a32_mention_lanes", f"""WITH {ARTICLES}, {MENTIONS}, o AS (SELECT external_id, min(source) AS team FROM articles GROUP BY 1), f AS (SELECT article_external_id, bool_or(entity_type = 'team') AS has_team, bool_or(entity_type IN ('person', 'competition')) AS has_other, array_to_string(list_sort(list_distinct(list(entity_type))), '+') AS types FROM mentions GROUP BY 1),
m AS (SELECT o.*, has_team, has_other, types FROM o LEFT JOIN f ON f.article_external_id = o.external_id)
SELECT 'totals' AS part, CAST(NULL AS VARCHAR) AS name, count(*) AS n_articles, count(has_team) AS n_linked, CAST(floor((2 * count(has_team) * 100 + count(*)) / (2 * count(*))) AS BIGINT) AS n_mentions FROM m
UNION ALL SELECT 'type', entity_type, count(DISTINCT article_external_id), count(DISTINCT article_external_id), count(*) FROM mentions GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'team', team, count(*), count(has_team), count(*) FILTER (has_team) FROM m GROUP BY team ORDER BY count(*) DESC, team LIMIT 25)
UNION ALL SELECT 'gap', types, count(*), count(*), 0 FROM m WHERE has_other AND NOT has_team GROUP BY types""")
def a32(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d)
    n = F.length("title_original")
    first = a.where(n % 3 > 0).select(F.col("external_id").alias("article_external_id"), F.element_at(F.array(*map(F.lit, ("team", "person", "competition", "venue"))), (n % 4 + 1).cast("int")).alias("entity_type"))
    teams = a.where(F.length(F.concat("source", "title_original")) % 5 == 0).select("external_id", F.lit("team"))
    return dashboard.mention_lanes(a.select("external_id", F.col("source").alias("team")), first.union(teams))


@query("a33_tool_usage", f"""WITH {RUNS}, c AS (SELECT CAST(ran_at AS DATE) AS day, method AS tool, CASE WHEN outlet_id % 2 = 0 THEN 'inspection' ELSE 'unclassified' END AS traffic, CASE WHEN ok THEN 'success' ELSE 'error' END AS outcome, response_ms AS duration_ms FROM runs UNION ALL SELECT CAST(ran_at AS DATE), CASE WHEN id % 8 = 0 THEN 'rss' ELSE 'inspect' END, 'inspection', CASE WHEN ok THEN 'success' ELSE 'refused' END, response_ms * 3 FROM runs WHERE id % 4 = 0)
SELECT day, tool, traffic, count(*) AS calls, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'error') AS errors, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, max(duration_ms) AS max_ms, count(*) FILTER (duration_ms < 100) AS under_100, count(*) FILTER (duration_ms >= 100 AND duration_ms < 500) AS under_500,
  count(*) FILTER (duration_ms >= 500 AND duration_ms < 2000) AS under_2000, count(*) FILTER (duration_ms >= 2000) AS from_2000, CAST(floor((2 * count(*) FILTER (outcome = 'error') * 100 + count(*)) / (2 * count(*))) AS BIGINT) AS error_pct, CAST(floor((2 * sum(duration_ms) + count(duration_ms)) / (2 * count(duration_ms))) AS BIGINT) AS mean_ms FROM c GROUP BY 1, 2, 3""")
def a33(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    success = lambda other: F.when(F.col("ok"), "success").otherwise(other).alias("outcome")
    one = r.select(F.to_date("ran_at").alias("day"), F.col("method").alias("tool"), F.when(F.col("outlet_id") % 2 == 0, "inspection").otherwise("unclassified").alias("traffic"), success("error"), F.col("response_ms").alias("duration_ms"))
    two = r.where("id % 4 = 0").select(F.to_date("ran_at").alias("day"), F.when(F.col("id") % 8 == 0, "rss").otherwise("inspect").alias("tool"), F.lit("inspection").alias("traffic"), success("refused"), (F.col("response_ms") * 3).alias("duration_ms"))
    return dashboard.tool_usage(one, two)


@query("a34_endpoint_health", f"""WITH {RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY outlet_id, method ORDER BY ran_at DESC, id DESC) AS k FROM runs)
SELECT method, count(*) AS endpoints, count(*) FILTER (ok) AS healthy, count(*) FILTER (NOT ok) AS unhealthy, count(*) FILTER (ok AND newest_item_published_at < {RUNS_AT} - INTERVAL 7 DAY) AS stale FROM l WHERE k = 1 GROUP BY 1""")
def a34(spark: SparkSession, d: str) -> DataFrame:
    return ops.endpoint_health(runs(spark, d), RUNS_AS_OF)


@query("a37_fix_backlog", f"""WITH {RUNS}, f AS (SELECT source AS domain, error AS reason, country, CAST(outlet_id AS VARCHAR) AS outlet, CASE WHEN id % 5 < 3 THEN 'retry' WHEN id % 5 = 3 THEN 'replace' ELSE 'disable' END AS action FROM runs WHERE NOT ok), p AS (SELECT domain, reason, action, count(*) AS n FROM f GROUP BY 1, 2, 3)
SELECT f.domain, f.reason, count(*) AS n, count(DISTINCT country) AS n_countries, array_to_string(list_sort(list_distinct(list(outlet)))[1:20], ',') AS outlets, (SELECT arg_max(action, (p.n, action)) FROM p WHERE p.domain = f.domain AND p.reason = f.reason) AS action FROM f GROUP BY f.domain, f.reason""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 5
    failed = runs(spark, d).where("not ok").select(F.col("source").alias("domain"), F.col("error").alias("reason"), "country", F.col("outlet_id").cast("string").alias("outlet"), F.when(k < 3, "retry").when(k == 3, "replace").otherwise("disable").alias("action"))
    return dashboard.fix_backlog(failed)


@query("a38_latest_per_source", f"WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY publication_datetime DESC, created_at DESC, external_id DESC) AS k FROM articles) SELECT source, external_id, url, publication_datetime FROM r WHERE k = 1 ORDER BY publication_datetime DESC, source LIMIT 40")
def a38(spark: SparkSession, d: str) -> DataFrame:
    return dashboard.latest_per_source(articles(spark, d))
