"""Queries over the log of endpoint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.operators import health, ops
from coverline.plans.registry import query
from coverline.plans.views import ARTICLES, AS_OF, AT, FEEDS, RUNS, RUNS_AS_OF, RUNS_AT, articles, feeds, runs, table

BASE = f"WITH {RUNS}"


def _newest(keys: str, where: str = "true") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ran_at DESC, id DESC) AS newest FROM runs WHERE {where}) WHERE newest = 1"


def _pct(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} > 0 THEN floor((2 * {part} * 100 + {whole}) / (2 * {whole})) ELSE 0 END AS BIGINT)"


@query("h1_latest_runs", f"{BASE} SELECT outlet_id, method, id, source, ran_at, ok, status_code, error FROM ({_newest('outlet_id, method', f'ran_at >= {RUNS_AT} - INTERVAL 720 MINUTE')})")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return health.latest_runs(runs(spark, d), RUNS_AS_OF, 720)


HEALTH = f"""n AS ({_newest('source, method')}), rec AS (SELECT source, method, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 24 HOUR GROUP BY 1, 2),
b AS (SELECT n.source, n.method, n.ran_at, n.ok, n.error, coalesce(attempts, 0) AS attempts, coalesce(failures, 0) AS failures, {_pct('coalesce(failures, 0)', 'coalesce(attempts, 0)')} AS pct FROM n LEFT JOIN rec ON rec.source = n.source AND rec.method = n.method),
s AS (SELECT *, CASE WHEN NOT ok AND pct >= 90 AND attempts > 0 THEN 'failing' WHEN NOT ok THEN 'degraded' WHEN pct >= 30 THEN 'warning' ELSE 'healthy' END AS health FROM b)"""


@query("h2_latest_health", f"{BASE}, {HEALTH} SELECT source, method, ran_at, ok, error, attempts, failures, health FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE health WHEN 'healthy' THEN 1 WHEN 'warning' THEN 2 WHEN 'degraded' THEN 3 WHEN 'failing' THEN 4 ELSE 5 END, method) AS k FROM s) WHERE k = 1")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return health.latest_health(runs(spark, d), RUNS_AS_OF)


@query("h3_failing_backoff", f"{BASE}, x AS (SELECT outlet_id, source, method, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 14400 MINUTE GROUP BY 1, 2, 3), y AS (SELECT *, {_pct('failures', 'attempts')} AS failure_pct FROM x) SELECT * FROM y WHERE attempts >= 4 AND failure_pct >= 60")
def h3(spark: SparkSession, d: str) -> DataFrame:
    return health.failing_backoff(runs(spark, d), RUNS_AS_OF, 14400, 4, 60)


@query("h4_failure_watchlist", f"""{BASE}, r AS (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY outlet_id, method, url ORDER BY ran_at DESC, id DESC) AS seen_ok FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 30 DAY),
p AS (SELECT outlet_id, method, url, count(*) AS attempts, count(*) FILTER (NOT ok) AS fails, count(*) FILTER (seen_ok = 0) AS streak, max(ran_at) FILTER (NOT ok) AS last_fail, max(ran_at) FILTER (ok) AS last_success, count(*) FILTER (NOT ok AND status_code IN (401, 403, 404, 410, 451)) AS permanent FROM r GROUP BY 1, 2, 3),
e AS (SELECT outlet_id, method, url, error, count(*) AS n, max((ran_at, id)) AS newest FROM r WHERE NOT ok GROUP BY 1, 2, 3, 4), t AS (SELECT outlet_id, method, url, arg_max(error, (n, newest)) AS top_reason FROM e GROUP BY 1, 2, 3),
sc AS (SELECT outlet_id, method, url, status_code, count(*) AS n, max((ran_at, id)) AS newest FROM r WHERE NOT ok AND status_code IS NOT NULL GROUP BY 1, 2, 3, 4), ts AS (SELECT outlet_id, method, url, arg_max(status_code, (n, newest)) AS top_status FROM sc GROUP BY 1, 2, 3),
q AS (SELECT p.*, top_reason, top_status, {_pct('fails', 'attempts')} AS failure_pct FROM p LEFT JOIN t ON t.outlet_id = p.outlet_id AND t.method = p.method AND t.url = p.url LEFT JOIN ts ON ts.outlet_id = p.outlet_id AND ts.method = p.method AND ts.url = p.url WHERE attempts >= 5)
SELECT *, CASE WHEN fails >= 8 AND streak >= 3 AND (failure_pct >= 50 OR (last_success IS NULL AND {_pct('permanent', 'fails')} >= 80)) THEN 'DISABLE_CANDIDATE' WHEN failure_pct >= 45 THEN 'WATCH' ELSE 'KEEP' END AS action FROM q""")
def h4(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.when(F.col("id") % 2 == 1, F.concat("url", F.lit("?utm_source=x"))).otherwise(F.col("url"))  # one endpoint in two spellings
    return health.failure_watchlist(runs(spark, d).withColumn("url", spelled), RUNS_AS_OF, disable_fails=8, disable_streak=3, disable_rate=50, watch_rate=45)


@query("h5_feed_stability", f"""{BASE}, x AS (SELECT outlet_id, method, count(*) AS attempts, count(*) FILTER (ok) AS successes, CAST(sum(CASE WHEN outlet_id % 6 = 1 THEN 0 ELSE fetched_count END) AS BIGINT) AS valid FROM runs WHERE attempted GROUP BY 1, 2), y AS (SELECT *, {_pct('successes', 'attempts')} AS success_pct FROM x)
SELECT *, CASE WHEN attempts < 15 THEN 'no_data' WHEN coalesce(valid, 0) = 0 THEN 'unstable' WHEN success_pct >= 80 THEN 'stable' WHEN success_pct >= 40 THEN 'warning' ELSE 'unstable' END AS stability, method = 'rss' AND attempts >= 15 AND successes > 0 AND coalesce(valid, 0) = 0 AS zero_valid FROM y""")
def h5(spark: SparkSession, d: str) -> DataFrame:
    empty = F.when(F.col("outlet_id") % 6 == 1, 0).otherwise(F.col("fetched_count"))
    return health.feed_stability(ops.ops_rollup(runs(spark, d).withColumn("fetched_count", empty), "day"), 15)


def _aged(r: DataFrame) -> DataFrame:
    """Newest items spread over weeks, so that every action occurs."""
    return r.withColumn("newest_item_published_at", F.expr("newest_item_published_at - make_dt_interval(cast(outlet_id % 50 % 31 as int) - 1)"))


@query("h6_stale_watchlist", f"""{BASE}, g AS (SELECT * REPLACE (newest_item_published_at - INTERVAL (outlet_id % 50 % 31 - 1) DAY AS newest_item_published_at) FROM runs),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, method ORDER BY ran_at DESC, id DESC) AS k FROM g WHERE ok) WHERE k = 1),
p AS (SELECT source, max(newest_item_published_at) AS newest_item, string_agg(method, '+' ORDER BY method) AS methods FROM n GROUP BY 1),
q AS (SELECT *, CAST(datediff('day', newest_item, {RUNS_AT}) AS BIGINT) AS stale_days FROM p)
SELECT *, CASE WHEN newest_item > {RUNS_AT} THEN 'FUTURE_DATED_HOLD' WHEN source IN ('src-3', 'src-20') THEN 'EXEMPT_ARCHIVE' WHEN source LIKE '%9' AND stale_days >= 7 THEN 'HIGH_VALUE_STALE_HOLD' WHEN stale_days >= 14 THEN 'AUTO_DISABLE' WHEN stale_days >= 7 THEN 'DISABLE_CANDIDATE' WHEN stale_days >= 3 THEN 'WATCH' ELSE 'KEEP' END AS action, newest_item <= {RUNS_AT} AND source NOT IN ('src-3', 'src-20') AND source NOT LIKE '%9' AND stale_days >= 20 AS safe_disable FROM q""")
def h6(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return health.stale_watchlist(_aged(r), r.where("source in ('src-3', 'src-20')").select("source").distinct(), RUNS_AS_OF, F.col("source").endswith("9"), safe_days=20)


PLAIN = r"regexp_replace(regexp_replace(lower({}), '^https?://(www\.)?', ''), '(\?.*)?/*$', '')"


@query("h7_auto_repair", f"""{BASE}, n AS ({_newest('source, method, url')}), f AS (SELECT source, method AS failed_method, url AS failed_url FROM n WHERE NOT ok AND outlet_id % 7 <> 6),
c AS (SELECT f.*, n.method, n.url, row_number() OVER (PARTITION BY f.source, failed_method, failed_url ORDER BY n.ran_at DESC, n.fetched_count DESC, n.url) AS k FROM f JOIN n ON n.source = f.source AND n.ok AND n.url <> f.failed_url),
x AS (SELECT source, failed_method, failed_url, method, url, CASE WHEN failed_method = 'rss' AND method = 'sitemap' THEN 'rss_to_sitemap' WHEN {PLAIN.format('failed_url')} = {PLAIN.format('url')} THEN 'canonical' ELSE 'other' END AS kind FROM c WHERE k = 1)
SELECT *, CASE WHEN kind = 'other' THEN 'REVIEW' ELSE 'AUTO_APPLY' END AS decision FROM x""")
def h7(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return health.auto_repair(r, r.where("outlet_id % 7 <> 6").select("url"))


BACKLOG = f"""n AS ({_newest('source, outlet_id, method, url')}), w AS (SELECT source, url AS works_url, ran_at AS works_at FROM ({_newest('source', 'ok')})),
bl AS (SELECT n.source, n.outlet_id, n.method, n.url, n.ran_at, works_url, CASE WHEN works_url IS NULL THEN 'find_replacement' WHEN works_url = n.url THEN 'retry_later' WHEN works_at > n.ran_at THEN 'use_working_url' ELSE 'review' END AS action
  FROM n LEFT JOIN w ON w.source = n.source WHERE status_code = 403 AND n.outlet_id NOT IN (SELECT outlet_id FROM feeds WHERE NOT enabled))"""


@query("h8_hard_403_backlog", f"{BASE}, {FEEDS}, {BACKLOG} SELECT * FROM bl")
def h8(spark: SparkSession, d: str) -> DataFrame:
    return health.hard_403_backlog(runs(spark, d), feeds(spark, d))


#: The endpoints of the log as registrations, some in another spelling, and redirects between some.
REGISTERED = "CASE outlet_id % 4 WHEN 0 THEN replace(url, 'https://', 'http://www.') || '/' WHEN 1 THEN url || '?utm=1' ELSE url END"
MOVED = "(outlet_id % 50) % 5 = 0 AND outlet_id % 7 IN (2, 3)"


@query("h8_follow_ups", f"""WITH RECURSIVE {FEEDS}, {RUNS}, {BACKLOG}, en AS (SELECT DISTINCT country, source, method, outlet_id % 17 <> 0 AND id_min % 3 <> 0 AS enabled, {REGISTERED} AS url, outlet_id FROM (SELECT country, source, method, url, outlet_id, min(id) AS id_min FROM runs GROUP BY ALL) UNION SELECT DISTINCT country, source, method, TRUE, url, outlet_id FROM runs WHERE outlet_id % 3 > 0),
ep AS (SELECT country, source, method, enabled, url FROM en), rd AS (SELECT DISTINCT url AS from_url, regexp_replace(url, '[0-9]$', '6') AS to_url FROM runs WHERE {MOVED}), us AS (SELECT * FROM bl WHERE action = 'use_working_url'),
ls AS (SELECT url FROM ep UNION SELECT url FROM bl UNION SELECT works_url FROM us UNION SELECT from_url FROM rd UNION SELECT to_url FROM rd), pl AS (SELECT url AS a, '~' || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '^www[.]', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS b FROM ls UNION SELECT from_url, to_url FROM rd UNION SELECT url, works_url FROM us),
bi AS (SELECT a, b FROM pl UNION SELECT b, a FROM pl), rc AS (SELECT a AS node, a AS seen FROM bi UNION SELECT rc.node, bi.b FROM rc JOIN bi ON bi.a = rc.seen), cm AS (SELECT node AS url, min(seen) FILTER (NOT starts_with(seen, '~')) AS class_url FROM rc WHERE NOT starts_with(node, '~') GROUP BY 1),
ow AS (SELECT country, method, class_url, count(*) FILTER (enabled) AS n_enabled, count(*) FILTER (NOT enabled) AS n_disabled FROM ep JOIN cm ON cm.url = ep.url GROUP BY 1, 2, 3),
rf AS (SELECT country, bl.method, class_url, count(*) AS n_refused, arg_max(bl.url, (ran_at, bl.url)) AS from_url, arg_max(works_url, (ran_at, works_url)) FILTER (action = 'use_working_url') AS to_url FROM bl JOIN (SELECT DISTINCT source, method, url, country FROM ep) e ON e.source = bl.source AND e.method = bl.method AND e.url = bl.url JOIN cm ON cm.url = bl.url GROUP BY 1, 2, 3),
al AS (SELECT coalesce(ow.country, rf.country) AS country, coalesce(ow.method, rf.method) AS method, coalesce(ow.class_url, rf.class_url) AS class_url, coalesce(n_enabled, 0) AS n_enabled, coalesce(n_disabled, 0) AS n_disabled, coalesce(n_refused, 0) AS n_refused, from_url, to_url FROM ow FULL JOIN rf ON rf.country = ow.country AND rf.method = ow.method AND rf.class_url = ow.class_url)
SELECT * FROM (SELECT country, method, class_url, CASE WHEN n_refused > 0 THEN CASE WHEN to_url IS NULL THEN 'find_replacement' WHEN EXISTS (SELECT 1 FROM ep WHERE enabled AND ep.country = al.country AND ep.method = al.method AND ep.url = to_url) THEN 'disable_duplicate' ELSE 'canonical_swap' END WHEN n_enabled > 0 AND n_disabled > 0 THEN 'remove_disabled' END AS action, n_enabled, n_disabled, n_refused, from_url, to_url FROM al) WHERE action IS NOT NULL""")
def h8_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    k = F.col("outlet_id")
    of = r.groupBy("country", "source", "method", "url", "outlet_id").agg(F.min("id").alias("id_min"))
    spelled = F.when(k % 4 == 0, F.concat(F.regexp_replace("url", "https://", "http://www."), F.lit("/"))).when(k % 4 == 1, F.concat("url", F.lit("?utm=1"))).otherwise(F.col("url"))
    one = of.select("country", "source", "method", ((k % 17 != 0) & (F.col("id_min") % 3 != 0)).alias("enabled"), spelled.alias("url"), "outlet_id")
    two = of.where(k % 3 > 0).select("country", "source", "method", F.lit(True).alias("enabled"), "url", "outlet_id")
    endpoints = one.unionByName(two).distinct().drop("outlet_id")
    moved = r.where(((k % 50) % 5 == 0) & (k % 7).isin(2, 3)).select(F.col("url").alias("from_url"), F.regexp_replace("url", "[0-9]$", "6").alias("to_url")).distinct()
    return health.follow_ups(health.hard_403_backlog(r, feeds(spark, d)), endpoints, moved)


@query("h9_waf_triage", f"""{BASE}, {FEEDS}, {BACKLOG}, c AS (SELECT *, regexp_extract(url, '^https://([^/]*)', 1) AS host FROM bl), k AS (SELECT *, count(*) OVER (PARTITION BY host) AS host_n FROM c)
SELECT source, outlet_id, method, url, host, host_n, CASE WHEN host_n >= 10 THEN 'host_family' WHEN host_n >= 4 THEN 'host_group' WHEN action = 'use_working_url' THEN 'swap' WHEN method = 'sitemap' THEN 'sitemap_alone' ELSE 'single' END AS queue FROM k""")
def h9(spark: SparkSession, d: str) -> DataFrame:
    return health.waf_triage(health.hard_403_backlog(runs(spark, d), feeds(spark, d)))


RISK = f"""a AS (SELECT * REPLACE ('src-' || (CAST(right(source, 9) AS BIGINT) % 50) AS source) FROM articles), hd AS (SELECT source, count(*) AS created_24h FROM a WHERE created_at >= {AT} - INTERVAL 24 HOUR GROUP BY 1 HAVING count(*) >= 3),
hr AS (SELECT source, date_trunc('hour', publication_datetime) AS hour, count(*) AS n FROM a WHERE publication_datetime >= {AT} - INTERVAL 7 DAY GROUP BY 1, 2), pk AS (SELECT source, max(n) AS peak FROM hr GROUP BY 1),
fd AS (SELECT source, min(fetched_count) FILTER (method = 'rss' AND ok AND fetched_count > 0) AS least_fetched, CAST(quantile_disc(fetched_count, 0.5) FILTER (method = 'rss' AND ok AND fetched_count > 0) AS BIGINT) AS median_fetched, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, bool_and(method = 'rss') AS rss_only FROM runs WHERE attempted AND ran_at >= {RUNS_AT} - INTERVAL 7 DAY GROUP BY 1),
rk AS (SELECT hd.source, created_24h, peak, least_fetched, median_fetched, successes, failures, rss_only, CASE WHEN peak >= least_fetched THEN 'STRICT' WHEN 2 * peak >= least_fetched THEN 'ONE_MISS' ELSE 'NONE' END AS risk FROM hd JOIN pk ON pk.source = hd.source JOIN fd ON fd.source = hd.source)"""


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    return articles(spark, d).withColumn("source", F.concat(F.lit("src-"), (F.substring("source", -9, 9).cast("long") % 50).cast("string")))


@query("h10_head_risk", f"{BASE}, {ARTICLES}, {RISK} SELECT * FROM rk")
def h10(spark: SparkSession, d: str) -> DataFrame:
    return health.head_risk(_renamed(spark, d), runs(spark, d), AS_OF, RUNS_AS_OF, 3)


@query("h11_scheduling_coverage", f"""{BASE}, {ARTICLES}, {RISK}, n AS ({_newest('source, outlet_id, method')}), p AS (SELECT source, count(*) AS feeds, count(*) FILTER (ok) AS working, max(ran_at) AS last_run FROM n GROUP BY 1)
SELECT rk.source, risk, feeds, working, last_run, CASE WHEN coalesce(feeds, 0) = 0 THEN 'no_feeds' WHEN working = 0 THEN 'all_failing' WHEN working = feeds THEN 'covered' ELSE 'partly_covered' END AS status FROM rk LEFT JOIN p ON p.source = rk.source WHERE risk <> 'NONE'""")
def h11(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return health.scheduling_coverage(health.head_risk(_renamed(spark, d), r, AS_OF, RUNS_AS_OF, 3), r)


@query("h12_outlet_schedule", f"""WITH RECURSIVE {ARTICLES}, c AS (SELECT source, count(*) AS n FROM articles WHERE created_at >= {AT} - INTERVAL 24 HOUR AND source < 'Supplier#000000060' GROUP BY 1),
o AS (SELECT s_suppkey AS outlet_id, s_name AS source, coalesce(n, 0) AS n FROM supplier LEFT JOIN c ON c.source = s_name), hd AS (SELECT outlet_id FROM o WHERE n >= 10 ORDER BY n DESC, outlet_id LIMIT 8),
h AS (SELECT outlet_id, CAST(outlet_id AS VARCHAR) AS t, 0 AS i, CAST(2166136261 AS BIGINT) AS hash FROM o UNION ALL SELECT outlet_id, t, i + 1, (xor(hash, CAST(ascii(t[i + 1]) AS BIGINT)) * 16777619) & 4294967295 FROM h WHERE i < length(t))
SELECT o.outlet_id, source, n, hash % 6 AS slot, CASE WHEN o.outlet_id IN (SELECT outlet_id FROM hd) THEN 'head' WHEN n > 0 THEN 'warm' WHEN hash % 6 = 2 THEN 'cold' ELSE 'skipped' END AS tier FROM o JOIN h ON h.outlet_id = o.outlet_id AND i = length(t)""")
def h12(spark: SparkSession, d: str) -> DataFrame:
    counts = articles(spark, d).where((F.col("created_at") >= F.lit("1998-06-30").cast("timestamp_ntz")) & (F.col("source") < "Supplier#000000060")).groupBy("source").agg(F.count("*").alias("n"))
    return health.outlet_schedule(table(spark, d, "supplier").select(F.col("s_suppkey").alias("outlet_id"), F.col("s_name").alias("source")), counts, 8, 10, 8)


def with_unknown(runs: DataFrame) -> DataFrame:
    """The log with a failure among its statuses that tells nothing."""
    odd = (F.col("status_code") == 500) & (F.col("id") % 3 == 0)
    return runs.withColumns({"status_code": F.when(odd, 418).otherwise(F.col("status_code")), "error": F.when(odd, "http_418").otherwise(F.col("error"))})


POLICY_SQL = """ru AS (SELECT * REPLACE (CASE WHEN status_code = 500 AND id % 3 = 0 THEN 418 ELSE status_code END AS status_code) FROM runs), r AS (SELECT runs.*, coalesce(tw.outlet_id IS NOT NULL, FALSE) AS twin, CASE WHEN ok THEN NULL WHEN status_code = 410 THEN 'http_410' WHEN status_code = 404 THEN 'http_404' WHEN status_code IN (403, 500) THEN 'http_' || status_code WHEN error = 'timed out' THEN 'timeout' END AS failure, row_number() OVER (PARTITION BY runs.outlet_id ORDER BY ran_at, id) AS k FROM ru runs LEFT JOIN tw ON tw.outlet_id = runs.outlet_id WHERE attempted AND method = 'sitemap'),
f AS (SELECT outlet_id, CAST(0 AS BIGINT) AS k, 'active' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(0 AS BIGINT) AS consecutive_failures, CAST(NULL AS INTEGER) AS last_status_code, CAST(NULL AS TIMESTAMP) AS disabled_until, CAST(NULL AS TIMESTAMP) AS updated_at FROM (SELECT DISTINCT outlet_id FROM r) UNION ALL
  SELECT r.outlet_id, r.k, CASE WHEN ok THEN 'active' WHEN gone THEN 'disabled_permanent' WHEN paused THEN 'disabled_temporary' ELSE status END, CASE WHEN ok THEN NULL WHEN gone OR paused THEN failure ELSE reason END, CASE WHEN ok THEN 0 ELSE consecutive_failures + 1 END, status_code, CASE WHEN ok THEN NULL WHEN gone THEN ran_at + INTERVAL 30 DAY WHEN paused THEN ran_at + INTERVAL 7 DAY WHEN failure IS NULL AND status <> 'active' AND disabled_until <= ran_at THEN CASE status WHEN 'disabled_temporary' THEN ran_at + INTERVAL 7 DAY ELSE ran_at + INTERVAL 30 DAY END ELSE disabled_until END, ran_at
  FROM (SELECT r.*, f.status, f.reason, f.consecutive_failures, f.disabled_until, failure = 'http_410' OR (failure = 'http_404' AND (twin OR f.consecutive_failures + 1 >= 3)) AS gone, failure IS NOT NULL AND f.consecutive_failures + 1 >= 2 AS paused FROM f JOIN r ON r.outlet_id = f.outlet_id AND r.k = f.k + 1) r)
SELECT outlet_id, status, reason, consecutive_failures, last_status_code, disabled_until, updated_at FROM f WHERE k = (SELECT max(r.k) FROM r WHERE r.outlet_id = f.outlet_id)"""
NO_TWINS = "tw AS (SELECT CAST(NULL AS BIGINT) AS outlet_id WHERE FALSE)"
TWINS = "nx AS (SELECT source, country, outlet_id, arg_max(ok, (ran_at, id)) AS ok FROM runs WHERE attempted AND method = 'sitemap' GROUP BY 1, 2, 3), tw AS (SELECT DISTINCT a.outlet_id FROM nx a JOIN nx b ON a.source = b.source AND a.country = b.country AND a.outlet_id <> b.outlet_id AND b.ok)"


@query("h13_sitemap_policy", f"WITH RECURSIVE {RUNS}, {TWINS}, {POLICY_SQL}")
def h13(spark: SparkSession, d: str) -> DataFrame:
    r = with_unknown(runs(spark, d))
    return health.sitemap_policy(r, health.living_twins(r))


LIMITED = "lr AS (SELECT * REPLACE (CASE WHEN status_code = 500 AND id % 3 = 0 THEN 429 ELSE status_code END AS status_code), CASE WHEN id % 2 = 0 THEN ran_at + INTERVAL (id % 90) MINUTE END AS retry_after_at FROM runs)"


@query("h14_recovery_plan", f"""{BASE}, {LIMITED}, r AS (SELECT *, max(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY outlet_id, method, url ORDER BY ran_at DESC, id DESC) AS seen_ok FROM lr),
p AS (SELECT outlet_id, method, url, count(*) AS failures, arg_max_null(status_code, (ran_at, id)) AS status_code, arg_max_null(retry_after_at, (ran_at, id)) AS told, max(ran_at) AS ran_at FROM r WHERE attempted AND NOT ok AND seen_ok = 0 GROUP BY 1, 2, 3),
q AS (SELECT *, CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code = 403 THEN 'access_restricted' WHEN status_code IN (404, 410) THEN 'missing_endpoint' WHEN status_code = 500 THEN 'server_error' ELSE 'transport' END AS category, regexp_extract(url, '^https://([^/]*)', 1) AS host FROM p),
t AS (SELECT outlet_id, method, url, failures, status_code, ran_at, category, CASE category WHEN 'rate_limited' THEN 'wait_retry_after' WHEN 'access_restricted' THEN 'review_access' WHEN 'missing_endpoint' THEN 'review_replacement' ELSE 'bounded_backoff' END AS action, category IN ('access_restricted', 'missing_endpoint') AS review, host,
  CASE WHEN category = 'rate_limited' THEN CASE WHEN told IS NULL THEN ran_at + INTERVAL 6 HOUR ELSE greatest(told, ran_at + INTERVAL 1 MINUTE) END WHEN category IN ('access_restricted', 'missing_endpoint') THEN ran_at + INTERVAL 7 DAY ELSE ran_at + INTERVAL (CAST(least(pow(2, least(greatest(failures, 1), 8)), 168) AS BIGINT)) HOUR END AS retry_at FROM q)
SELECT *, max(retry_at) OVER (PARTITION BY host) AS host_until FROM t""")
def h14(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    limited = F.when((F.col("status_code") == 500) & (k % 3 == 0), 429).otherwise(F.col("status_code"))
    told = F.when(k % 2 == 0, F.expr("ran_at + make_dt_interval(0, 0, cast(id % 90 as int))"))
    return health.recovery_plan(runs(spark, d).withColumns({"status_code": limited, "retry_after_at": told}), RUNS_AS_OF)


ACCOUNTS = "acc AS (SELECT c_custkey AS id, c_custkey // 3 AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'video' END AS platform, lower(c_name) AS handle, c_custkey % 4 = 0 AS is_primary FROM customer)"


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.floor(k / 3).cast("long").alias("person_id"), F.when(k % 2 == 0, "x").otherwise("video").alias("platform"), F.lower("c_name").alias("handle"), (k % 4 == 0).alias("is_primary"))


@query("h15_latest_profiles", f"""WITH {ACCOUNTS}, p AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY is_primary DESC, id) AS k FROM acc),
s AS (SELECT o_orderkey AS id, o_custkey AS social_account_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS snapshot_at, CAST(floor(o_totalprice) AS BIGINT) AS followers_count FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY social_account_id ORDER BY snapshot_at DESC NULLS LAST, id DESC) AS k FROM s)
SELECT person_id, p.id AS account_id, platform, handle, followers_count, snapshot_at FROM p LEFT JOIN n ON n.social_account_id = p.id AND n.k = 1 WHERE p.k = 1""")
def h15(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    snaps = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("social_account_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("snapshot_at"), F.floor("o_totalprice").cast("long").alias("followers_count"))
    return health.latest_profiles(_accounts(spark, d), snaps)


@query("h16_social_upsert", f"""WITH {ACCOUNTS}, e AS (SELECT platform, handle, id AS followers, 'old' AS media FROM acc WHERE id % 3 > 0), n AS (SELECT platform, handle, CASE WHEN id % 7 > 0 THEN id * 2 END AS followers, CASE WHEN id % 5 > 0 THEN 'new' END AS media FROM acc WHERE id % 3 < 2)
SELECT coalesce(n.platform, e.platform) AS platform, coalesce(n.handle, e.handle) AS handle, coalesce(n.media, e.media) AS media, CASE WHEN n.handle IS NOT NULL THEN n.followers ELSE e.followers END AS followers,
  CASE WHEN n.handle IS NULL THEN 'a=1;b=1' WHEN e.handle IS NULL THEN 'b=2;c=2' ELSE 'a=1;b=2;c=2' END AS metadata, CASE WHEN e.handle IS NULL THEN 'inserted' WHEN n.handle IS NULL THEN 'kept' ELSE 'updated' END AS change FROM e FULL JOIN n ON e.platform = n.platform AND e.handle = n.handle""")
def h16(spark: SparkSession, d: str) -> DataFrame:
    acc = _accounts(spark, d)
    m = lambda **kv: F.create_map(*(F.lit(x) for p in kv.items() for x in p))
    old = acc.where("id % 3 > 0").select("platform", "handle", F.col("id").alias("followers"), F.lit("old").alias("media"), m(a="1", b="1").alias("metadata"))
    new = acc.where("id % 3 < 2").select("platform", "handle", F.when(F.col("id") % 7 > 0, F.col("id") * 2).alias("followers"), F.when(F.col("id") % 5 > 0, "new").alias("media"), m(b="2", c="2").alias("metadata"))
    out = health.social_upsert(old, new, ["platform", "handle"], ["media"], ["followers"])
    return out.withColumn("metadata", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda x: F.concat_ws("=", x.key, x.value))), ";"))


@query("h17_freshness_state", f"WITH {ARTICLES}, s AS (SELECT source, CASE WHEN right(source, 1) <> '7' THEN CAST(datediff('day', max(publication_datetime), TIMESTAMP '1998-07-01') + CAST(right(source, 2) AS BIGINT) AS BIGINT) END AS age_days FROM articles GROUP BY 1) SELECT *, CASE WHEN age_days IS NULL THEN 'unknown' WHEN age_days < 30 THEN 'fresh' WHEN age_days < 90 THEN 'monitor' ELSE 'stale' END AS state FROM s")
def h17(spark: SparkSession, d: str) -> DataFrame:
    newest = articles(spark, d).groupBy("source").agg(F.max("publication_datetime").alias("last"))
    age = F.datediff(F.lit("1998-07-01").cast("timestamp_ntz"), "last").cast("long") + F.substring("source", -2, 2).cast("long")
    return newest.select("source", F.when(~F.col("source").endswith("7"), age).alias("age_days")).withColumn("state", health.freshness_state(F.col("age_days")))
