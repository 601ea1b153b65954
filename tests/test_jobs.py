"""Small cases with known answers: ties, nulls, order of arrival, baselines, local days, streams against batches."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coverline.functions import columns, dates, titles, urls
from coverline.functions.folding import fold_text
from coverline.operators import activity, benchmark, classify, compare, health, merge
from coverline.plans import flows, texts
from coverline.plans.views import AS_OF, articles, feeds, runs
from coverline.sources import registry, rules
from coverline.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def time(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


# first discovery

C = "id string, endpoint_id string, checked_at timestamp_ntz, status string, format string, urls array<string>, sources array<struct<source_id string, country string>>"
S1, S2, S3 = ("s1", "c1"), ("s2", "c1"), ("s3", "c2")
BASE = "https://a.example.com/news/story-"


def collections(spark, rows):
    return activity.collected(spark.createDataFrame(rows, C))


def found(df, key):
    return sorted((r[key], r.url, r.id) for r in df.collect())


def test_baseline_is_not_new_and_later_links_are(spark):
    c = collections(spark, [("1", "e", time(1), "working_nonempty", "rss", [BASE + "1"], [S1]), ("2", "e", time(2), "working_nonempty", "rss", [BASE + "1", BASE + "2", BASE + "2?utm_source=x"], [S1]), ("2", "e", time(3), "working_nonempty", "rss", [BASE + "3"], [S1])])
    assert found(activity.new_candidates(c, "source"), "source_id") == [("s1", BASE + "2", "2")]


def test_valid_empty_documents_make_a_baseline_and_failures_do_not(spark):
    c = collections(spark, [("1", "e", time(1), "valid_empty", "rss", [], [S1]), ("2", "e", time(2), "working_nonempty", "rss", [BASE + "1"], [S1]), ("3", "f", time(1), "timeout", None, [], [S3]), ("4", "f", time(2), "working_nonempty", "rss", [BASE + "9"], [S3])])
    assert found(activity.new_candidates(c, "source"), "source_id") == [("s1", BASE + "1", "2")]


def test_a_country_counts_a_link_once_and_waits_for_all_its_bindings(spark):
    both = [S1, S2]
    c = collections(spark, [("1", "e", time(1), "working_nonempty", "rss", [], [S1]), ("2", "e", time(2), "working_nonempty", "rss", [BASE + "1"], both), ("3", "e", time(3), "working_nonempty", "rss", [BASE + "2"], both), ("4", "g", time(1), "valid_empty", "rss", [], [S3]), ("5", "g", time(4), "working_nonempty", "rss", [BASE + "2"], [S3])])
    assert found(activity.new_candidates(c, "country"), "country") == [("c1", BASE + "2", "3"), ("c2", BASE + "2", "5")]
    assert ("s1", BASE + "1", "2") in found(activity.new_candidates(c, "source"), "source_id")


def test_indexes_of_sitemaps_are_left_out(spark):
    c = collections(spark, [("1", "e", time(1), "working_nonempty", "sitemapindex", [BASE + "0"], [S1]), ("2", "e", time(2), "working_nonempty", "urlset", [BASE + "1"], [S1])])
    assert found(activity.new_candidates(c, "source"), "source_id") == [] and activity.first_last_seen(c, "url").count() == 1


def test_local_days_follow_summer_time(spark):
    rows = [(str(k), "e", t, "working_nonempty", "urlset", [BASE + str(k)], [S1]) for k, t in enumerate([datetime(2024, 3, 30, 22, 30), datetime(2024, 3, 30, 23, 30), datetime(2024, 3, 31, 21, 30), datetime(2024, 3, 31, 22, 30)])]
    c = collections(spark, rows)
    bindings = spark.createDataFrame([("s1", "e", datetime(2024, 1, 1), None)], "source_id string, endpoint_id string, since timestamp_ntz, until timestamp_ntz").withColumn("source_id", F.lit(S1[0]))
    periods = activity.activity_periods(activity.new_candidates(c, "source"), c, bindings, "source_id", "Europe/Berlin", date(2024, 3, 30), date(2024, 4, 1), datetime(2024, 1, 1))
    days = {str(r.day): (r.new, r.state) for r in periods.collect()}
    assert days == {"2024-03-30": (0, "complete"), "2024-03-31": (2, "complete"), "2024-04-01": (1, "complete")}


# merging

A = "external_id string, stable_id string, publication_datetime timestamp_ntz, title_original string, title_quality string, source_country string, feed_categories array<string>, seen long"


def test_dedupe_prefers_quality_then_time_then_arrival(spark):
    rows = [("a", "s", time(3), "late but suspect", "suspect", "X", ["p"], 1), ("b", "s", time(2), "good", "ok", None, ["q"], 2), ("c", "s", time(2), "good, second", "ok", "Y", None, 3), ("d", None, time(1), "alone", "ok", None, [], 4), ("d", None, time(1), "alone again", "ok", "Z", ["r"], 5)]
    got = {r.external_id: r for r in merge.dedupe_articles(spark.createDataFrame(rows, A), ["external_id", "stable_id", "publication_datetime", "title_original", "title_quality", "source_country"], ["feed_categories"]).collect()}
    assert set(got) == {"b", "d"} and got["b"].title_original == "good" and got["b"].source_country == "Y" and got["b"].feed_categories == ["p", "q"]
    assert got["d"].title_original == "alone" and got["d"].source_country == "Z"


def test_upsert_is_idempotent(spark, small):
    a = articles(spark, small).dropDuplicates(["external_id"])
    once = merge.upsert_articles(a.limit(0), a, AS_OF)
    again = merge.upsert_articles(once, a, AS_OF)
    assert {r.change for r in once.select("change").distinct().collect()} == {"inserted"} and {r.change for r in again.select("change").distinct().collect()} == {"updated"}
    keys = ["external_id", "title_original", "title_quality", "source", "url", "stable_id", "created_at"]
    assert once.select(*keys).exceptAll(again.select(*keys)).count() == 0 and again.count() == once.count()


def test_clusters_are_anchored_not_chained(spark):
    title = "A long enough headline about harbour plans"
    rows = [(k, "https://a.example.com/x", title, t) for k, t in enumerate([time(5, 12), time(4, 6), time(3, 0), time(1, 0)])] + [(9, "https://b.example.com/x", title, time(5)), (10, "https://a.example.com/y", "Short", time(5)), (11, "https://a.example.com/y", title, None)]
    items = spark.createDataFrame(rows, "id long, link string, title string, published_at timestamp_ntz")
    got = {r.id: (r.anchor_id, r.cluster_size) for r in merge.collapse_syndicated(items, spark.createDataFrame([("a.example.com", "n")], "host string, network string")).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 9: (9, 1), 10: (10, 1), 11: (11, 1)}


# checks

R = "id long, ran_at timestamp_ntz, outlet_id long, method string, url string, attempted boolean, ok boolean, status_code int, error string"


def test_streak_counts_back_from_the_newest_attempt(spark):
    rows = [(1, time(1), 1, "rss", "u", True, False, 500, "x"), (2, time(2), 1, "rss", "u", True, True, 200, None), (3, time(4), 1, "rss", "u", True, False, 404, "y"), (4, time(3), 1, "rss", "u", True, False, 404, "y"), (5, time(5), 1, "rss", "u", False, False, 404, "y"), (6, time(4), 2, "rss", "v", True, False, 404, "y")]
    got = health.failure_watchlist(spark.createDataFrame(rows, R), datetime(2024, 1, 10), min_attempts=2).collect()
    assert [(r.outlet_id, r.attempts, r.fails, r.streak, r.top_reason, r.action) for r in got] == [(1, 4, 3, 2, "y", "WATCH")]


def test_policy_folds_in_order_of_time(spark):
    bad = lambda k, t, code, outlet=1, error="e": (k, t, outlet, "sitemap", "u", True, False, code, error)
    rows = [bad(3, time(3), 404), bad(1, time(1), 500), bad(2, time(2), 500), bad(4, time(4), 410, 2), bad(5, time(5), 500, 2), bad(6, time(1), 500)]
    rows += [bad(7, time(1), None, 3, "Timed out"), bad(8, time(2), None, 3, "timeout"), bad(9, time(1), 404, 4), bad(10, time(1), None, 5, "odd"), bad(11, time(2), None, 5, "odd"), bad(12, time(1), 404, 6)]
    twins = spark.createDataFrame([(6,)], "outlet_id long")
    got = {r.outlet_id: (r.status, r.reason, r.consecutive_failures, r.last_status_code, r.disabled_until) for r in health.sitemap_policy(spark.createDataFrame(rows, R), twins).collect()}
    later = lambda day, days: time(day) + timedelta(days=days)
    assert got == {
        1: ("disabled_permanent", "http_404", 4, 404, later(3, 30)), 2: ("disabled_temporary", "http_500", 2, 500, later(5, 7)), 3: ("disabled_temporary", "timeout", 2, None, later(2, 7)),
        4: ("active", None, 1, 404, None), 5: ("active", None, 2, None, None), 6: ("disabled_permanent", "http_404", 1, 404, later(1, 30)),
    }


def test_policy_by_aggregates_equals_the_fold(spark):
    rng = random.Random(4)
    kinds = [(200, None), (301, None), (404, None), (404, None), (410, None), (500, None), (503, None), (None, "timed out"), (None, "aborted"), (None, "odd"), (418, "odd")]
    rows = [(k, time(rng.randint(1, 20)), rng.randint(1, 60), "sitemap", "u", True, rng.random() < 0.25, *rng.choice(kinds)) for k in range(500)]
    twins = spark.createDataFrame([(k,) for k in range(1, 60, 3)], "outlet_id long")
    frame = spark.createDataFrame(rows, R)
    want = {}
    for r in sorted(health.policy_rows(frame, twins).collect(), key=lambda r: (r.ran_at, r.id)):
        want[r.outlet_id] = health.policy_step(want.get(r.outlet_id, dict(health.NEW_POLICY)), r)
    found = health.sitemap_policy(frame, twins)
    assert {r.outlet_id: {c: r[c] for c in health.NEW_POLICY} for r in found.collect()} == want
    assert "Pandas" not in found._jdf.queryExecution().toString()


# rules


def test_keywords_of_any_length_and_script(spark):
    rules = classify.keyword_table(spark, (("high", "bank of the south", "business"), ("high", "выборы", "politics"), ("medium", "選挙", "politics"), ("medium", "انتخابات", "world"), ("high", "covid-19", "health"), ("medium", "경제", "business")))
    texts = ["the Bank of the South, again", "Сегодня ВЫБОРЫ!", "昨日の選挙の結果", "عن انتخابات اليوم", "a covid 19 case", "한국경제는", "bank of the north", "перевыборы", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", fold_text("text").alias("folded"))
    got = {r.doc_id: r.section for r in classify.classify_keyword(docs, "doc_id", F.col("folded"), rules).collect()}
    assert [got[k] for k in range(len(texts))] == ["business", "politics", "politics", "world", "health", "business", "others", "others", "others"]


def test_folding_is_that_of_decomposition(spark):
    import unicodedata

    texts = ["Élan VITAL naïve Ångström", "Ελλάδα Ψυχή", "ёлка Йод", "Việt Nam", "ﬁne ½ №5 ＡＢＣ …", "plain ascii Text", "é combining", None, "日本語 한국"]
    plain = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    got = {r.i: r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fold_text("t").alias("x")).collect()}
    assert [got[k] for k in range(len(texts) - 1)] == [plain(t) for t in texts[:-1]] and got[len(texts) - 1] == "日本語 한국"


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "k.csv").write_text("priority,tier,keyword,section\n1,high,stock market,business\n2,medium,été,lifestyle\n")
    (tmp_path / "p.csv").write_text("rule_no,kind,pattern,countries,publisher\n1,prefix,the daily,A;B,Daily Group\n2,exact,north post,,North\n")
    (tmp_path / "bad.csv").write_text("priority,tier,keyword,section\none,high,x,y\n")
    keywords = rules.read_rules(spark, str(tmp_path / "k.csv"), "keywords")
    docs = spark.createDataFrame([(1, "The Stock  Market falls"), (2, "un ETE chaud"), (3, "stock of the market")], "doc_id long, text string")
    assert {r.doc_id: r.section for r in classify.classify_keyword(docs, "doc_id", fold_text("text"), keywords).collect()} == {1: "business", 2: "lifestyle", 3: "others"}
    names = spark.createDataFrame([("The Daily Sun", "A"), ("The Daily Sun", "C"), ("North Post", "C")], "source string, country string")
    publishers = rules.read_rules(spark, str(tmp_path / "p.csv"), "publishers")
    assert {(r.source, r.country): r.publisher for r in classify.resolve_publisher(names, publishers).collect()} == {("The Daily Sun", "A"): "Daily Group", ("The Daily Sun", "C"): "The Daily Sun", ("North Post", "C"): "North"}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        rules.read_rules(spark, str(tmp_path / "bad.csv"), "keywords").collect()
    hinted = rules.small(keywords, 2)._jdf.queryExecution().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in rules.small(keywords, 1)._jdf.queryExecution().toString().lower()


def test_greedy_lift_counts_what_earlier_candidates_lack(spark):
    items = [("n", c, link, link) for c, links in (("a", "123"), ("b", "3456"), ("c", "12"), ("d", "9")) for link in links]
    got = sorted((r.place, r.candidate, r.lift, r.penalty, r.n_links, r.overlap) for r in compare.candidate_lift(spark.createDataFrame(items, "network string, candidate string, title string, link string"), spark.createDataFrame([("9", "9")], "title string, link string")).collect())
    assert got == [(1, "b", 4, 0, 4, 0), (2, "a", 2, 1, 3, 0), (3, "c", 0, 2, 2, 0), (4, "d", 0, 0, 1, 1)]


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    schema = "country string, created_at timestamp, publication_datetime timestamp"
    row = lambda day, hour=1: ("c", time(day, hour), time(day, 0))
    for k, rows in enumerate([[row(1)], [row(9)], [row(9)], [row(1, 2), row(9, 2)], [row(10)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = jobs.drained(spark, stream, lambda s: jobs.benchmark_stream(s, "1 day", "24 hours", "1 hour"), "update", str(tmp_path / "state"))
    assert out.dropped == 24 and jobs.last_of(out, ["bucket", "country"]).agg(F.sum("inserted")).first()[0] == 24 * 5


def test_streams_equal_their_batches(spark, small):
    r = runs(spark, small).withColumns({"ran_at": F.col("ran_at").cast("timestamp"), "runner": F.when(F.col("id") % 5 < 2, "worker").otherwise("manual")})
    keys = ["bucket", "runner", "outlet_id", "method", "attempts", "failures"]
    batch = jobs.rollup(r).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).select(*keys)
    stream = flows.st1(spark, small).select(*keys)
    assert batch.count() > 0 and batch.exceptAll(stream).count() == stream.exceptAll(batch).count() == 0


# benchmark and snapshots


def test_parity_of_one_day_with_all_days(spark, small):
    a, f, day = articles(spark, small), feeds(spark, small), datetime(1998, 6, 20)
    every = benchmark.benchmark_days(a, f).where(F.col("bucket") == F.lit("1998-06-20").cast("timestamp_ntz"))
    assert benchmark.benchmark_parity(benchmark.country_benchmark_daily(a, f, day), every, ["country"], ["published", "inserted", "fresh", "late", "active_sources", "top5_share_bps"]).count() == 0


def test_a_snapshot_slice_is_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    rows = lambda n: spark.range(n).select(F.col("id").alias("country"))
    for n, bucket in ((3, "d1"), (5, "d2"), (2, "d1")):
        benchmark.write_snapshot(rows(n), path, bucket, "v1")
    got = {r.bucket_key: r["count"] for r in spark.read.parquet(path).groupBy("bucket_key").count().collect()}
    assert got == {"d1": 2, "d2": 5}


def test_registry_file(spark, tmp_path):
    file = tmp_path / "registry.json"
    file.write_text(json.dumps({"countries": [{"code": "xx", "name": " Xland ", "feeds": [{"name": "One", "url": "https://One.example/rss#a"}, {"name": "one ", "url": "https://one.example/rss", "enabled": False}, {"name": " "}, {"name": "Map", "sitemapUrl": "https://m.example/s.xml"}]}, {"code": "yy", "name": "Y", "feeds": []}]}))
    rows = registry.read_registry(spark, str(file))
    assert sorted((r.country, r.source, r.enabled) for r in rows.collect()) == [("Xland", "Map", True), ("Xland", "One", True), ("Xland", "one", False)]
    sources, endpoints, links = registry.normalize_registry(rows)
    assert {(r.name, r.n_endpoints) for r in sources.collect()} == {("one", 1), ("map", 1)} and {(r.type, r.status) for r in endpoints.collect()} == {("rss", "unknown"), ("sitemap", "active")} and links.count() == 2


# functions


@pytest.mark.parametrize(("raw", "want"), [
    ("https://A.example.com:443/x/?b=2&a=1&utm_source=q&ref=z#f", "https://a.example.com/x?a=1&b=2"), ("http://a.example.com", "http://a.example.com/"), ("https://www.bing.com/news/apiclick.aspx?x=1&url=https%3a%2f%2fb.example.com%2fy%2f&c=2", "https://b.example.com/y"),
    (" not a link/ ", "not a link"), ("https://a.example.com/x?y=1&amp;a=2", "https://a.example.com/x?a=2&y=1"), (None, ""),
])
def test_links(spark, raw, want):
    assert one(spark, urls.normalize_link(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("1704067200", datetime(2024, 1, 1)), ("1704067200000", datetime(2024, 1, 1)), ("2024-01-02", datetime(2024, 1, 2, 12)), ("Tue, 02 Jan 2024 03:04:05 GMT", datetime(2024, 1, 2, 3, 4, 5)), ("Tue, 2 Jan 2024 03:04:05 -0500", datetime(2024, 1, 2, 8, 4, 5)),
    ("2024-01-02T03:04:05+01:00", datetime(2024, 1, 2, 2, 4, 5)), ("2024-07-01 12:00:00 Europe/Paris", datetime(2024, 7, 1, 10)), ("yesterday", None), (None, None), ("", None),
])
def test_dates(spark, raw, want):
    assert one(spark, dates.parse_loose_date(F.lit(raw).cast("string")).cast("timestamp_ntz")) == want


def test_texts(spark):
    assert one(spark, titles.clean_text(F.lit("a&amp;amp;b &#233;&#x1F984; &lt;c&gt;\x00 d  e &#99999999; &unknown;"), 100)) == "a&b é🦄 <c> d e &#99999999; &unknown;"
    assert one(spark, titles.display_source(F.lit("The  Paper - World - News Sitemap 3"))) == "The Paper" and one(spark, titles.display_source(F.lit("A -  B"))) == "A - B"
    got = one(spark, titles.assess_title(F.lit("c12 345.html"), F.lit("https://a.example.com/2024/harbour-plan-gets-vote-123456.html")))
    assert (got.quality, got.readable) == ("recovered", "Harbour plan gets vote")


def test_rounding_is_half_up(spark):
    assert one(spark, columns.percent(F.lit(1), F.lit(200))) == 1 and one(spark, columns.basis_points(F.lit(1), F.lit(3))) == 3333 and one(spark, columns.percent(F.lit(1), F.lit(0))) == 0


def test_feeds_are_of_bounded_size_and_counted_whole(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("text of it").alias("text"), F.lit("en").alias("lang"), F.lit("src_2").alias("source"), F.lit(10).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    feeds_ = texts._feeds_xml(spark, str(tmp_path)).select(F.size(F.split("body", "<item>")).alias("n")).collect()
    assert len(feeds_) == 20 and {r.n for r in feeds_} == {51}
    assert [(r.total, r.valid) for r in texts.p3(spark, str(tmp_path)).collect()] == [(50, 50)] * 20


def test_fnv(spark):
    assert one(spark, health.fnv1a(F.lit("foobar"))) == 0xBF9CF968


def test_feeds_of_a_stream_share_groups(spark, tmp_path, monkeypatch):
    """Two batches over 300 feeds, one without a name: each is held against its own watermark, in no more groups than there are."""
    monkeypatch.setattr(jobs, "GROUPS", 4, raising=False)
    schema = "id long, outlet_id long, method string, published_at timestamp_ntz, last_publication_at timestamp_ntz"
    outlet = lambda k: None if k == 7 else k
    one = [(k, outlet(k), "rss", time(20, k % 24), time(20, 11) if k % 2 else None) for k in range(300)]
    two = [(1000 + k, outlet(k), "rss", time(20, 12), time(1)) for k in range(300)] + [(2000, 5, "rss", None, None)]
    for rows in (one, two):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.drained(spark, stream, lambda s: jobs.new_items_stream(s, datetime(2024, 1, 31)), "append", str(tmp_path / "state"))
    first = {k for k in range(300) if k % 2 == 0 or k % 24 > 11}
    # the second batch has noon for all: news where the first left nothing newer, and not where it kept noon or later
    second = {1000 + k for k in range(300) if not (k in first and k % 24 >= 12)} | {2000}
    rows = out.collect()
    assert {r.id for r in rows} == first | second and len(rows) == len(first | second)
    assert {r.id % 1000: r.outlet_id for r in rows if r.id < 2000} == {k: outlet(k) for k in {i % 1000 for i in (first | second) - {2000}}}
    assert "group" in jobs.new_items_stream(stream, datetime(2024, 1, 31))._jdf.queryExecution().analyzed().toString()
