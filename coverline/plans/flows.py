"""Queries of first discovery (L1 to L4) and of the streaming jobs (ST1 to ST6)."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.operators import activity
from coverline.plans import checks
from coverline.plans.registry import SQL, query
from coverline.plans.ship import shared_folder
from coverline.plans.texts import HOST, PATH, Q
from coverline.plans.views import ARTICLES, RUNS, articles, runs, table
from coverline.streaming import jobs, policy

STATUS = "CASE event_type WHEN 'click' THEN 'working_nonempty' WHEN 'view' THEN 'working_nonempty' WHEN 'purchase' THEN 'valid_empty' WHEN 'error' THEN 'http_error' ELSE 'timeout' END"


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Collections of endpoints: each shows a few pages; some ids come twice, some documents are indexes."""
    e, p = table(spark, d, "events"), table(spark, d, "pages")
    keyed = e.withColumn("n", p.agg(F.count("*")).scalar())
    picks = keyed.select("event_id", F.explode(F.array(F.col("event_id") % F.col("n"), (F.col("event_id") * 7 + 3) % F.col("n"))).alias("page_id"))
    urls = picks.join(p.select("page_id", "url"), "page_id").groupBy("event_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    k = F.col("user_id")
    good = F.when(F.col("event_type").isin("click", "view"), "working_nonempty").when(F.col("event_type") == "purchase", "valid_empty").when(F.col("event_type") == "error", "http_error").otherwise("timeout")
    sources = F.array(F.struct(F.concat(F.lit("s"), (k % 40).cast("string")).alias("source_id"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("country")), F.struct(F.concat(F.lit("t"), (k % 30).cast("string")).alias("source_id"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("country")))
    rows = e.join(urls, "event_id").select(
        F.col("event_id").alias("id"), F.concat(F.lit("ep-"), (k % 60).cast("string")).alias("endpoint_id"), F.col("ts").cast("timestamp_ntz").alias("checked_at"), good.alias("status"), F.when(F.col("event_id") % 11 == 0, "sitemapindex").otherwise("urlset").alias("format"),
        F.when(F.col("event_type") == "purchase", F.array().cast("array<string>")).otherwise(F.col("urls")).alias("urls"), sources.alias("sources"),
    )
    replay = rows.where("id % 13 = 0").withColumn("checked_at", F.expr("checked_at + INTERVAL '1' DAY"))
    return rows.unionByName(replay)


A_URL = rf"lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END || coalesce('?' || nullif(array_to_string([p FOR p IN {Q} IF p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(string_split(p, '=')[1]) NOT IN ('fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid')], '&'), ''), '')"
OBS = rf"""np AS (SELECT count(*) AS n FROM pages), ob AS (SELECT event_id AS id, 'ep-' || (user_id % 60) AS endpoint_id, ts AS checked_at, {STATUS} AS status, event_type, user_id, {STATUS} IN ('working_nonempty', 'valid_empty') AND event_id % 11 <> 0 AS useful FROM events),
sr AS (SELECT id, 's' || (user_id % 40) AS source_id, 'c' || (user_id % 5) AS country FROM ob UNION ALL SELECT id, 't' || (user_id % 30), 'c' || (user_id % 4) FROM ob),
pk AS (SELECT event_id AS id, event_id % n AS page_id FROM events, np UNION ALL SELECT event_id, (event_id * 7 + 3) % n FROM events, np), pu AS (SELECT page_id, {A_URL} AS url FROM pages),
lk AS (SELECT DISTINCT ob.id, endpoint_id, checked_at, pu.url FROM ob JOIN pk ON pk.id = ob.id JOIN pu ON pu.page_id = pk.page_id WHERE useful AND event_type <> 'purchase'),
sl AS (SELECT lk.*, source_id, country FROM lk JOIN sr ON sr.id = lk.id),
bs AS (SELECT source_id, endpoint_id, min((checked_at, ob.id)) AS baseline FROM ob JOIN sr ON sr.id = ob.id WHERE useful GROUP BY 1, 2)"""
KIND = f"CASE WHEN regexp_matches(lower({PATH}), '^/*$') OR (regexp_matches(lower({PATH}), '^/[^/]+/?$') AND NOT regexp_matches({PATH}, '[0-9]')) OR regexp_matches(lower({PATH}), '^/(tag|tags|topic|topics|category|categories|section|author|forum|forums|search)(/|$)') THEN 'uncertain' ELSE 'candidate' END"


def _new_sql(key: str) -> str:
    return f"""kn AS (SELECT sl.*, baseline < (checked_at, id) AS before FROM sl JOIN bs ON bs.source_id = sl.source_id AND bs.endpoint_id = sl.endpoint_id), pr AS (SELECT {key}, url, id, checked_at, endpoint_id, bool_and(before) AS before FROM kn GROUP BY 1, 2, 3, 4, 5),
nw AS (SELECT {key}, url, id, endpoint_id, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY {key}, url ORDER BY checked_at, id) AS k FROM pr) WHERE k = 1 AND before AND {KIND} = 'candidate')"""


for _scope, _keys in (("url", ""), ("endpoint", "endpoint_id, "), ("binding", "source_id, endpoint_id, "), ("source", "source_id, "), ("country", "country, ")):
    query(f"l1_first_last_seen_{_scope}", f"WITH {OBS} SELECT {_keys}url, min(checked_at) AS first_seen, max(checked_at) AS last_seen FROM sl GROUP BY {_keys}url")(lambda spark, d, scope=_scope: activity.first_last_seen(activity.collected(observations(spark, d)), scope))
for _scope, _key in (("source", "source_id"), ("country", "country")):
    query(f"l2_new_candidates_{_scope}", f"WITH {OBS}, {_new_sql(_key)} SELECT * FROM nw")(lambda spark, d, scope=_scope: activity.new_candidates(activity.collected(observations(spark, d)), scope))


#: The log 75 days later, so that its days hold a clock change; on some local days nothing works, on some nothing was checked.
LOCAL = "CAST(checked_at + CASE WHEN checked_at < TIMESTAMP '2024-03-31 01:00:00' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS DATE)"
SHIFTED = OBS.replace("ts AS checked_at", "ts + INTERVAL 75 DAY AS checked_at").replace(f"{STATUS} AS status", f"CASE WHEN {{down}} THEN 'timeout' ELSE {STATUS} END AS status").replace(f"{STATUS} IN ('working_nonempty', 'valid_empty') AND", f"NOT ({{down}}) AND {STATUS} IN ('working_nonempty', 'valid_empty') AND").replace("AS useful FROM events", "AS useful FROM events WHERE NOT ({gone})")
SHIFTED = SHIFTED.replace("{down}", "dayofyear(ts) % 10 = 4").replace("{gone}", "dayofyear(ts) % 10 = 7")
#: The first and last day of the report, in its zone the hour that a day begins in UTC, and since when the history goes back.
FIRST, LAST, HISTORY = date(2024, 3, 14), date(2024, 4, 13), datetime(2024, 3, 18)


@query("l3_activity_periods", f"""WITH {SHIFTED}, {_new_sql('country')}, rw AS (SELECT ob.*, source_id, country, {LOCAL} AS day, id_index FROM (SELECT *, id % 11 = 0 AS id_index FROM ob) ob JOIN sr ON sr.id = ob.id),
bn AS (SELECT country, endpoint_id, min(checked_at) AS since, CASE WHEN CAST(substr(endpoint_id, 4) AS INTEGER) % 7 = 0 THEN min(checked_at) + INTERVAL 20 DAY END AS until FROM rw GROUP BY 1, 2),
sp AS (SELECT country, CAST(day AS DATE) AS day, CAST(day AS TIMESTAMP) - CASE WHEN day <= DATE '2024-03-31' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS day_from, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY - CASE WHEN day < DATE '2024-03-31' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END AS day_to FROM (SELECT DISTINCT country FROM bn UNION ALL SELECT 'nowhere'), generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) AS g(day)),
be AS (SELECT country, min(checked_at) AS began FROM rw GROUP BY 1), ex AS (SELECT sp.country, sp.day, count(DISTINCT endpoint_id) AS expected FROM sp JOIN (SELECT * FROM bn UNION ALL SELECT 'nowhere', 'ep-x', TIMESTAMP '2024-01-01', NULL) bn ON bn.country = sp.country AND since < day_to AND (until IS NULL OR until > day_from) GROUP BY 1, 2),
ck AS (SELECT country, day, count(DISTINCT endpoint_id) AS targeted, count(DISTINCT endpoint_id) FILTER (useful) AS successful, count(DISTINCT id) FILTER (status NOT IN ('working_nonempty', 'valid_empty')) AS failed_checks, count(DISTINCT id) FILTER (id_index) AS index_only_checks FROM rw GROUP BY 1, 2),
nd AS (SELECT country, {LOCAL} AS day, count(*) AS n FROM nw GROUP BY 1, 2), st AS (SELECT sp.*, CASE WHEN began IS NULL OR day_to <= began THEN 'not_tracked' WHEN day_from < TIMESTAMP '{HISTORY}' THEN 'history_not_in_snapshot' WHEN targeted IS NULL THEN 'not_collected' WHEN successful = 0 THEN 'failed_or_index_only' WHEN successful < coalesce(expected, 0) THEN 'partial' ELSE 'complete' END AS state,
  coalesce(expected, 0) AS expected, coalesce(targeted, 0) AS targeted, coalesce(successful, 0) AS successful, coalesce(failed_checks, 0) AS failed_checks, coalesce(index_only_checks, 0) AS index_only_checks, coalesce(n, 0) AS n FROM sp LEFT JOIN be USING (country) LEFT JOIN ex USING (country, day) LEFT JOIN ck USING (country, day) LEFT JOIN nd USING (country, day))
SELECT * EXCLUDE (n), CASE WHEN state IN ('partial', 'complete') THEN n END AS new FROM st""")
def l3(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofyear("checked_at")
    gone = table(spark, d, "events").where(F.dayofyear("ts") % 10 == 7).select(F.col("event_id").alias("id"))
    o = observations(spark, d).join(gone, "id", "left_anti").withColumn("status", F.when(day % 10 == 4, "timeout").otherwise(F.col("status"))).withColumn("checked_at", F.expr("checked_at + INTERVAL '75' DAY"))
    c = activity.collected(o)
    country = F.explode(F.array_distinct(F.transform("sources", lambda s: s.country))).alias("country")
    first = c.select("endpoint_id", "checked_at", country).groupBy("country", "endpoint_id").agg(F.min("checked_at").alias("since"))
    until = F.when(F.substring_index("endpoint_id", "-", -1).cast("int") % 7 == 0, F.expr("since + INTERVAL '20' DAY"))
    nowhere = spark.createDataFrame([("nowhere", "ep-x", datetime(2024, 1, 1), None)], "country string, endpoint_id string, since timestamp_ntz, until timestamp_ntz")
    return activity.activity_periods(activity.new_candidates(c, "country"), c, first.withColumn("until", until).unionByName(nowhere), "country", "Europe/Berlin", FIRST, LAST, HISTORY)


@query("l3_rolling_new", f"WITH {OBS}, {_new_sql('country')} SELECT country, count(*) AS new FROM nw WHERE checked_at >= TIMESTAMP '2024-01-02' AND checked_at < TIMESTAMP '2024-01-03' GROUP BY 1")
def l3r(spark: SparkSession, d: str) -> DataFrame:
    c = activity.collected(observations(spark, d))
    return activity.rolling_new(activity.new_candidates(c, "country"), "country", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))


@query("l4_activity_archive", f"WITH {OBS}, {_new_sql('source_id')} SELECT strftime(checked_at, '%Y-%m') AS month, source_id, count(*) AS n_records, min(checked_at) AS first_seen, max(checked_at) AS last_seen FROM nw GROUP BY 1, 2")
def l4(spark: SparkSession, d: str) -> DataFrame:
    return activity.activity_archive(activity.new_candidates(activity.collected(observations(spark, d)), "source"), "source_id")


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams"


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log of checks as a stream of the events table's files."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    ok = F.col("event_type").isin("click", "view", "purchase")
    status = F.when(ok, F.lit(200)).otherwise(F.element_at(F.array(*(F.lit(x) for x in (403, 404, 500, 410))), (F.col("event_id") % 4 + 1).cast("int")))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ran_at"), F.col("user_id").alias("outlet_id"), F.concat(F.lit("src-"), (F.col("user_id") % 50).cast("string")).alias("source"), F.when(F.col("event_id") % 3 == 0, "sitemap").otherwise("rss").alias("method"), (F.col("event_type") != "signup").alias("attempted"), ok.alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("fetched_count"), F.when(ok | (F.col("event_id") % 10 != 7), status).alias("status_code"), F.when(~ok & (F.col("event_id") % 10 == 7), "timed out").alias("error"))


@query("st1_stream_ops_rollup", f"WITH {RUNS} SELECT CAST(date_trunc('hour', ran_at) AS TIMESTAMP) AS bucket, CASE WHEN id % 5 < 2 THEN 'worker' ELSE 'manual' END AS runner, outlet_id, method, count(*) AS attempts, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, CAST(sum(fetched_count) AS BIGINT) AS fetched FROM runs WHERE attempted GROUP BY 1, 2, 3, 4")
def st1(spark: SparkSession, d: str) -> DataFrame:
    runner = F.when(F.col("id") % 5 < 2, "worker").otherwise("manual")
    out = jobs.drained(spark, _events_stream(spark, d).withColumn("runner", runner), lambda s: jobs.rollup(s, late="1 hour"), "update", _shared(spark))
    return jobs.last_of(out, ["bucket", "runner", "outlet_id", "method"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


ITEMS = "i AS (SELECT id, outlet_id, method, CASE WHEN id % 9 > 0 THEN ran_at END AS published_at FROM runs), w AS (SELECT outlet_id, method, max(ran_at) AS last_publication_at FROM runs WHERE ran_at < TIMESTAMP '2024-01-20' AND outlet_id % 4 > 0 GROUP BY 1, 2)"


#: Feeds are read as usual, sitemaps in a backfill that looks past their watermarks.
PASSES = """((i.method = 'rss' AND (published_at IS NULL OR published_at > greatest(coalesce(last_publication_at, TIMESTAMP '1900-01-01'), TIMESTAMP '2024-01-17'))) OR (i.method = 'sitemap' AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-20'))"""
BACKFILL = (datetime(2024, 1, 10), datetime(2024, 1, 20))


@query("st2_new_items", f"WITH {RUNS}, {ITEMS} SELECT i.* FROM i LEFT JOIN w ON w.outlet_id = i.outlet_id AND w.method = i.method WHERE {PASSES}")
def st2(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d)[0]


@query("st2_watermarks", f"WITH {RUNS}, {ITEMS}, k AS (SELECT i.* FROM i LEFT JOIN w ON w.outlet_id = i.outlet_id AND w.method = i.method WHERE {PASSES}), s AS (SELECT outlet_id, method, max(published_at) AS seen FROM k GROUP BY 1, 2) SELECT coalesce(w.outlet_id, s.outlet_id) AS outlet_id, coalesce(w.method, s.method) AS method, greatest(last_publication_at, seen) AS last_publication_at FROM w FULL JOIN s ON w.outlet_id = s.outlet_id AND w.method = s.method")
def st2w(spark: SparkSession, d: str) -> DataFrame:
    return _new(spark, d)[1]


def _new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = runs(spark, d)
    items = r.select("id", "outlet_id", "method", F.when(F.col("id") % 9 > 0, F.col("ran_at")).alias("published_at"))
    marks = r.where((F.col("ran_at") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("outlet_id") % 4 > 0)).groupBy("outlet_id", "method").agg(F.max("ran_at").alias("last_publication_at"))
    feeds = jobs.new_items(items.where("method = 'rss'"), marks.where("method = 'rss'"), datetime(2024, 1, 31))
    maps = jobs.new_items(items.where("method = 'sitemap'"), marks.where("method = 'sitemap'"), datetime(2024, 1, 31), backfill=BACKFILL, ignore_watermark=True)
    return feeds[0].unionByName(maps[0]), feeds[1].unionByName(maps[1])


@query("st2_stream_items", SQL["st2_new_items"])
def st2s(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream over the log's files; the watermarks that feeds start from are a table beside it."""
    stream = _events_stream(spark, d).withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))
    marks = runs(spark, d).where((F.col("ran_at") < F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("outlet_id") % 4 > 0)).groupBy("outlet_id", "method").agg(F.max("ran_at").alias("last_publication_at"))
    items = stream.select("id", "outlet_id", "method", F.when(F.col("id") % 9 > 0, F.col("ran_at")).alias("published_at")).join(marks, ["outlet_id", "method"], "left")
    feeds = jobs.drained(spark, items.where("method = 'rss'"), lambda s: jobs.new_items_stream(s, datetime(2024, 1, 31)), "append", _shared(spark))
    maps = jobs.drained(spark, items.where("method = 'sitemap'"), lambda s: jobs.new_items_stream(s, datetime(2024, 1, 31), backfill=BACKFILL, ignore_watermark=True), "append", _shared(spark))
    return feeds.unionByName(maps).drop("batch")


@query("st3_stream_dedupe", "SELECT DISTINCT user_id % 50 || '-' || event_id % 400 AS external_id FROM events")
def st3(spark: SparkSession, d: str) -> DataFrame:
    rows = _events_stream(spark, d).select(F.concat((F.col("outlet_id") % 50).cast("string"), F.lit("-"), (F.col("id") % 400).cast("string")).alias("external_id"), F.col("ran_at").alias("created_at"))
    return jobs.drained(spark, rows, lambda s: jobs.dedupe(s, "60 days"), "append", _shared(spark)).select("external_id")


@query("st4_stream_policy", f"WITH RECURSIVE {RUNS}, {checks.NO_TWINS}, {checks.POLICY_SQL}")
def st4(spark: SparkSession, d: str) -> DataFrame:
    stream = checks.with_unknown(_events_stream(spark, d))
    return jobs.last_of(jobs.drained(spark, stream, policy.policy_stream, "update", _shared(spark)), ["outlet_id"]).drop("blocked")


@query("st5_stream_backoff", f"""WITH {RUNS}, x AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, ran_at) AS b FROM runs WHERE attempted), s AS (SELECT x.*, b - INTERVAL (k * 5) MINUTE AS since FROM x, range(12) AS g(k))
SELECT since, source, method, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(*) FILTER (NOT ok) * 100 >= 60 * count(*)""")
def st5(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.drained(spark, _events_stream(spark, d), lambda s: jobs.backoff(s, late="1 hour"), "update", _shared(spark))
    return jobs.last_of(out, ["since", "source", "method"]).withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("st6_benchmark_batch", f"WITH {ARTICLES} SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS bucket, country, count(*) AS inserted, count(*) FILTER (least(publication_datetime, created_at) < date_trunc('hour', created_at)) AS late FROM articles GROUP BY 1, 2")
def st6(spark: SparkSession, d: str) -> DataFrame:
    a = articles(spark, d).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "publication_datetime")})
    return jobs.benchmark_stream(a).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("st6_stream_benchmark_24h", f"WITH {ARTICLES}, w AS (SELECT unnest(generate_series(date_trunc('hour', created_at) - INTERVAL 23 HOUR, date_trunc('hour', created_at), INTERVAL 1 HOUR)) AS bucket, country, least(publication_datetime, created_at) < date_trunc('hour', created_at) AS is_late FROM articles) SELECT bucket, country, count(*) AS inserted, count(*) FILTER (is_late) AS late FROM w GROUP BY 1, 2")
def st6s(spark: SparkSession, d: str) -> DataFrame:
    """Sliding days by the hour over the article table's files as a stream."""
    path = f"{_shared(spark)}/articles-{uuid.uuid4().hex}"
    rows = articles(spark, d).select("country", *(F.col(c).cast("timestamp").alias(c) for c in ("created_at", "publication_datetime")))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = jobs.drained(spark, stream, lambda s: jobs.benchmark_stream(s, "40 days", "24 hours", "1 hour"), "update", _shared(spark))
    return jobs.last_of(out, ["bucket", "country"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
