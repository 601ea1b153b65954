"""Syndicated titles, registrable domains and activity by local days against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from coverline.functions.domains import registrable_domains
from coverline.operators import activity, merge

TITLE = "One headline that many papers of a network print word for word"
START = datetime(2024, 1, 1)


def folded(rows, gap):
    """(id, anchor_id, size) by a walk from the newest."""
    out, anchor = {}, {}
    for i, network, title, at in sorted(rows, key=lambda r: (r[1], r[2], -r[3].timestamp(), r[0])):
        key = (network, title)
        if key not in anchor or anchor[key][1] - at > gap:
            anchor[key] = (i, at)
        out[i] = anchor[key][0]
    sizes = Counter(out.values())
    return {i: (a, sizes[a]) for i, a in out.items()}


@pytest.mark.parametrize("step", [1, 700, 20000])
def test_clusters_of_syndicated_titles(spark, step):
    rng = random.Random(step)
    rows = [(i, rng.choice(["east", "west"]), f"{TITLE} {rng.choice('ab')}", START + timedelta(minutes=rng.randrange(400) * step)) for i in range(600)]
    items = spark.createDataFrame([(i, f"https://{n}.example.com/{i}", t, at) for i, n, t, at in rows] + [(9000, "https://else.example.com/x", TITLE, START), (9001, "https://east.example.com/x", "short", START), (9002, "https://east.example.com/x", None, START), (9003, "https://east.example.com/x", TITLE, None)], "id long, link string, title string, published_at timestamp_ntz")
    networks = spark.createDataFrame([("east.example.com", "east"), ("west.example.com", "west")], "host string, network string")
    got = {r.id: r for r in merge.collapse_syndicated(items, networks).collect()}
    want = folded(rows, timedelta(hours=36)) | {i: (i, 1) for i in range(9000, 9004)}
    assert {i: (r.anchor_id, r.cluster_size) for i, r in got.items()} == want
    assert all((r.cluster_id is None) == (r.cluster_size == 1) for r in got.values())

    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        digits = ""
        while h:
            h, k = divmod(h, 36)
            digits = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + digits
        return digits or "0"

    fp = {i: f"{n}:{t.lower()}" for i, n, t, _ in rows}
    assert all(r.cluster_id == f"{fp[i].split(':')[0]}-{fnv(fp[i])}" for i, r in got.items() if r.cluster_id)


def test_one_title_spreads_over_tasks(spark):
    """A hot title: no task of the windows or joins holds a large part of it."""
    n = 60_000
    items = spark.range(n).select("id", F.lit("https://east.example.com/x").alias("link"), F.lit(TITLE).alias("title"), (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.pmod(F.col("id") * 7919, F.lit(n)) * 60)).cast("timestamp_ntz").alias("published_at"))
    networks = spark.createDataFrame([("east.example.com", "east")], "host string, network string")
    out = merge.collapse_syndicated(items, networks)
    assert out.count() == n and out.agg(F.max("cluster_size")).first()[0] == 36 * 60 + 1
    moments = items.select(F.lit("east").alias("network"), F.lit("x").alias("fp"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("t"))
    gap = 36 * 3_600_000_000
    slots = moments.groupBy(F.floor(F.col("t") / (gap // merge.GAP_SLOTS))).count()
    assert slots.agg(F.max("count")).first()[0] <= n // 500


RULES = ("com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "", "Org")


def test_registrable_domains(spark):
    want = {"a.b.example.com": "example.com", "example.com": "example.com", "com": None, "news.bbc.co.uk": "bbc.co.uk", "co.uk": None, "x.uk": "x.uk", "a.b.ck": "a.b.ck", "b.ck": None, "www.ck": "www.ck", "x.www.ck": "www.ck", "a.b.kawasaki.jp": "a.b.kawasaki.jp", "b.kawasaki.jp": None, "x.city.kawasaki.jp": "city.kawasaki.jp", "kawasaki.jp": "kawasaki.jp", "some.unknown": "some.unknown", "A.Example.ORG": "example.org", "localhost": None}
    hosts = spark.createDataFrame([(h,) for h in want] + [(None,), ("",), ("com",)], "host string")
    got = {r.host: r.domain for r in registrable_domains(hosts, spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()}
    assert got == {h.lower(): x for h, x in want.items()}


def test_source_countries_by_host_and_domain(spark):
    feeds = spark.createDataFrame([("One", "A", "https://one.com/rss", None), ("Two", "A", "https://www.two.co.uk/rss", None), ("Two", "B", "https://rss.two.com/x", "https://maps.two.org/s"), ("Two", "C", "https://shared.two.org/s", None)], "source string, country string, rss_url string, sitemap_url string")
    rows = [("1", "One", "https://x/"), ("2", "Two", "https://two.co.uk/a"), ("3", "Two", "https://m.rss.two.com/a"), ("4", "Two", "https://two.com/a"), ("5", "Two", "https://other.two.com/a"), ("6", "Two", "https://x.two.org/a"), ("7", "Two", "https://co.uk/a"), ("8", "None", "https://two.com/"), ("9", "Two", None)]
    got = {r.external_id: (r.assigned_country, r.decided_by) for r in merge.assign_source_country(spark.createDataFrame(rows, "external_id string, source string, url string"), feeds, spark.createDataFrame([(r,) for r in RULES], "rule string")).collect()}
    assert got == {"1": ("A", "source"), "2": ("A", "host"), "3": ("B", "host"), "4": ("B", "host"), "5": ("B", "host"), "6": (None, "unresolved"), "7": ("A", "host"), "8": (None, "unresolved"), "9": (None, "unresolved")}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Africa/Cairo", "America/Santiago", "Pacific/Apia", "UTC"])
def test_days_begin_where_the_local_date_changes(spark, zone):
    """Also where midnight itself is skipped by a clock change."""
    scopes = spark.createDataFrame([("a",)], "scope string")
    for first in (date(2024, 3, 25), date(2024, 4, 20), date(2024, 8, 28), date(2024, 10, 20)):
        rows = activity.day_spine(scopes, first, first + timedelta(days=20), zone).orderBy("day").collect()
        assert len(rows) == 21 and all(a.day_to == b.day_from for a, b in zip(rows, rows[1:]))
        for r in rows:
            local = lambda t: t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).date()
            assert local(r.day_from) == r.day and local(r.day_from - timedelta(seconds=1)) == r.day - timedelta(days=1)


def test_a_report_has_at_most_31_days(spark):
    for last in (date(2024, 2, 1), date(2023, 12, 31)):
        with pytest.raises(ValueError, match="31 days"):
            activity.day_spine(spark.createDataFrame([("a",)], "scope string"), date(2024, 1, 1), last, "UTC")


def test_states_of_days(spark):
    sources = [("s", "c")]
    rows = [(1, "e1", datetime(2024, 3, 30, 12), "working_nonempty", None, ["https://a/news/1-story"], sources), (2, "e2", datetime(2024, 3, 30, 22, 30), "timeout", None, [], sources), (3, "e1", datetime(2024, 3, 31, 21, 59), "valid_empty", None, [], sources), (4, "e2", datetime(2024, 3, 31, 22, 0), "working_nonempty", "sitemapindex", [], sources), (5, "e1", datetime(2024, 4, 2, 12), "working_nonempty", None, ["https://a/news/2-story"], sources), (6, "e2", datetime(2024, 4, 2, 13), "working_nonempty", None, [], sources)]
    c = activity.collected(spark.createDataFrame(rows, "id long, endpoint_id string, checked_at timestamp_ntz, status string, format string, urls array<string>, sources array<struct<source_id: string, country: string>>"))
    bindings = spark.createDataFrame([("c", "e1", datetime(2024, 1, 1), None), ("c", "e2", datetime(2024, 1, 1), datetime(2024, 4, 2, 0)), ("d", "e9", datetime(2024, 1, 1), None)], "country string, endpoint_id string, since timestamp_ntz, until timestamp_ntz")
    new = activity.new_candidates(c, "country")
    got = {(r.country, r.day.isoformat()): (r.state, r.new, r.expected, r.targeted) for r in activity.activity_periods(new, c, bindings, "country", "Europe/Berlin", date(2024, 3, 29), date(2024, 4, 3), datetime(2024, 3, 30, 20)).collect()}
    # the 31st has 23 hours: 23:00 to 22:00 in UTC
    assert got[("c", "2024-03-29")][0] == "not_tracked" and got[("c", "2024-03-30")][:2] == ("history_not_in_snapshot", None)
    assert got[("c", "2024-03-31")] == ("partial", 0, 2, 1) and got[("c", "2024-04-01")] == ("failed_or_index_only", None, 2, 1)
    assert got[("c", "2024-04-02")] == ("complete", 1, 2, 2) and got[("c", "2024-04-03")] == ("not_collected", None, 1, 0)
    assert {v[0] for k, v in got.items() if k[0] == "d"} == {"not_tracked"} and len(got) == 12
