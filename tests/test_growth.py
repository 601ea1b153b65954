"""Steps whose work must not grow faster than their input: copies, frequent keys, one pass over the articles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from coverline.operators import classify, merge
from coverline.sources import kept, registry
from coverline.sources.rules import SCHEMAS

LINKS = "external_id string, stable_id string, publication_datetime timestamp_ntz, url string"


def _drift_by_hand(rows):
    """(id, match, gap) by comparing every pair."""
    words = lambda url: {w for w in url.split("example.com/")[1].replace("/", "-").split("-") if len(w) >= 3}
    out = set()
    for i, stable, at, url in rows:
        if stable is None:
            found = []
            for j, other, t, link in rows:
                both, gap = len(words(url) & words(link)), abs(int((at - t).total_seconds()))
                if other and both >= 4 and gap <= 36 * 3600:
                    inside, shared = both / min(len(words(url)), len(words(link))), both / len(words(url) | words(link))
                    if inside >= 0.6 and shared >= 0.5:
                        found.append((-inside, -shared, gap, j))
            if found:
                out.add((i, min(found)[3], min(found)[2]))
    return out


def test_drift_takes_the_nearest_of_many_copies(spark):
    draw = random.Random(5)
    stories = ["one two-six seven-tea four five", "one-two six seven-tea-four-nine", "red blue-green-grey-pink", "red-blue-green-grey-pink-gold"]
    rows = [(f"r{k}", f"st-{k}" if draw.random() < 0.5 else None, datetime(2024, 1, 1) + timedelta(hours=draw.randrange(400)), "https://a.example.com/" + draw.choice(stories).replace(" ", "-")) for k in range(300)]
    got = merge.reconcile_url_drift(spark.createDataFrame(rows, LINKS)).select("external_id", "match_id", "gap_seconds").collect()
    assert {tuple(r) for r in got} == _drift_by_hand(rows)


def test_drift_makes_no_pairs_of_copies(spark):
    """200,000 rows of one link: as pairs they would be ten thousand million."""
    k = F.col("id")
    rows = spark.range(200_000).select(k.cast("string").alias("external_id"), F.when(k % 2 == 1, F.concat(F.lit("st-"), k.cast("string"))).alias("stable_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 20 as int))").alias("publication_datetime"), F.lit("https://a.example.com/one-two-six/seven-four-five").alias("url"))
    got = merge.reconcile_url_drift(rows).agg(F.count("*"), F.max("gap_seconds"), F.collect_set("match_id")).first()
    # a row of an even hour has ids of the hours before and after it as near; of both the smallest name is taken
    assert got[0] == 100_000 and got[1] == 3600 and set(got[2]) <= {str(x) for x in range(1, 200_000, 2)}


def test_country_of_hosts_under_one_domain_makes_no_pairs(spark):
    """60,000 hosts and as many feeds of one source under one domain: as pairs they would be thousands of millions."""
    k = F.col("id")
    link = lambda name, n: F.concat(F.lit(f"https://{name}"), n.cast("string"), F.lit(".big.com/x"))
    feeds = spark.range(60_000).select(F.lit("s").alias("source"), F.when(k == 7, "B").otherwise("A").alias("country"), link("f", k).alias("rss_url"), F.lit(None).cast("string").alias("sitemap_url"))
    alone = spark.createDataFrame([("s", "B", "https://b.net/rss", None), ("t", "C", "https://c.net/rss", None)], "source string, country string, rss_url string, sitemap_url string")
    rows = spark.range(60_000).select(k.cast("string").alias("external_id"), F.lit("s").alias("source"), link("a", k).alias("url"))
    more = spark.createDataFrame([("x", "s", "https://m.b.net/1"), ("y", "t", None), ("z", "u", "https://b.net/1"), ("f", "s", "https://f9.big.com/1")], "external_id string, source string, url string")
    out = merge.assign_source_country(rows.unionByName(more), feeds.unionByName(alone), spark.createDataFrame([("com",), ("net",)], "rule string"))
    got = {(r[0], r[1]): r[2] for r in out.groupBy("assigned_country", "decided_by").agg(F.count("*")).collect()}
    # the domain has feeds of two countries, also for the host of a feed
    assert got == {(None, "unresolved"): 60_002, ("B", "host"): 1, ("C", "source"): 1}


def _plan(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_latest_rows_read_twice_share_their_shuffle(spark):
    rows = spark.range(500).select((F.col("id") % 50).alias("key"), F.col("id").alias("seen"), (F.col("id") * 2).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    latest = merge.latest_first(rows, "key", ["seen"])
    assert sorted(tuple(r) for r in latest.collect()) == [(k, k, str(2 * k), str(k)) for k in range(50)]
    assert "ReusedExchange" in _plan(latest.select("key", "a").where("a <> '4'").join(latest.select("key", "b"), "key", "full"))


def test_taxonomy_reads_the_articles_once(spark, small):
    from coverline.plans.news import QUERIES

    assert _plan(QUERIES["c5_build_taxonomy"](spark, small)).count("lineitem.parquet") == 1


def _shuffled(spark, df):
    """Bytes that a query's stages write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    total = lambda listed: sum(listed.apply(k).shuffleWriteBytes() for k in range(listed.size()))
    before = total(stages())
    df.write.format("noop").mode("overwrite").save()
    return total(stages()) - before


def test_merged_rows_carry_their_rank_once(spark):
    """Ranks that do not compress: a copy for each of nine columns would be nine times the ids."""
    hashed = lambda *x: F.sha2(F.concat_ws("-", *x), 512)
    names = [f"c{k}" for k in range(8)]
    rows = spark.range(4_000).select(F.concat_ws("-", hashed("id"), hashed("id", "id")).alias("seen"), F.lit("ok").alias("title_quality"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("publication_datetime"), F.col("id").cast("string").alias("external_id"), F.lit(None).cast("string").alias("stable_id"), F.array().cast("array<string>").alias("feed_categories"), *(F.col("id").alias(c) for c in names))
    kept = rows.select(F.struct("seen", "external_id").alias("x")).groupBy("x").agg(F.count("*"))
    merged = merge.dedupe_articles(rows, ["external_id", "stable_id", "publication_datetime", "title_quality", *names], ["feed_categories"])
    assert len([x for x in _plan(merged).splitlines() if "min_by" in x]) == 0
    assert _shuffled(spark, merged) < 6 * _shuffled(spark, kept)


def _merged_by_hand(rows, columns):
    better = {"suspect": 0, "recovered": 2}
    def merge_by(rows, key):
        groups = {}
        for r in rows:
            groups.setdefault(key(r), []).append(r)
        out = []
        for group in groups.values():
            group.sort(key=lambda r: (-better.get(r["title_quality"], 1), r["publication_datetime"] is not None, -(r["publication_datetime"] or datetime(1970, 1, 1)).timestamp(), r["seen"]))
            one = {c: next((r[c] for r in group if r[c] is not None), None) for c in columns}
            out.append(one | {"tags": sorted({t for r in group for t in r["tags"] or []}), "seen": min(r["seen"] for r in group)})
        return out
    return merge_by(merge_by(rows, lambda r: ("s", r["stable_id"]) if r["stable_id"] is not None else ("e", r["external_id"])), lambda r: r["external_id"])


def test_merge_takes_what_a_row_lacks_from_the_next_best(spark):
    draw = random.Random(11)
    maybe = lambda x, p=0.4: None if draw.random() < p else x
    columns = ["external_id", "stable_id", "publication_datetime", "title_original", "title_quality", "country", "topic"]
    rows = [{"external_id": f"e{draw.randrange(60)}", "stable_id": maybe(f"s{draw.randrange(40)}"), "publication_datetime": maybe(datetime(2024, 1, 1 + draw.randrange(5)), 0.2), "title_original": maybe(f"t{k}", 0.2), "title_quality": maybe(draw.choice(["ok", "suspect", "recovered"]), 0.2), "country": maybe(f"c{k}"), "topic": maybe(f"p{k}"), "tags": maybe([draw.choice("abcd")]), "seen": f"{k:04}"} for k in range(300)]
    schema = "external_id string, stable_id string, publication_datetime timestamp_ntz, title_original string, title_quality string, country string, topic string, tags array<string>, seen string"
    got = merge.dedupe_articles(spark.createDataFrame([tuple(r.values()) for r in rows], schema), columns, ["tags"]).collect()
    show = lambda r: repr([r[c] for c in [*columns, "tags", "seen"]])
    assert sorted(show(r) for r in got) == sorted(show(r) for r in _merged_by_hand(rows, columns))


def test_items_of_one_story_fill_each_other(spark):
    at = datetime(2024, 1, 1)
    rows = [("s", "a", "title one", None, at, False, "ok", ["x"], "1"), ("s", None, None, "told", at, False, "ok", ["y"], "0"), (None, "b", "b", "d", None, True, "suspect", None, "2")]
    items = spark.createDataFrame(rows, "stable_id string, link string, title string, description string, published_at timestamp_ntz, published_at_is_fallback boolean, title_quality string, cats array<string>, seen string")
    got = sorted(tuple(r) for r in merge.merge_feed_items(items, ["link", "title", "description", "published_at"], ["cats"]).collect())
    assert got == [("a", "title one", "told", at, ["x", "y"], 2), ("b", "b", "d", None, [], 1)]


def test_places_and_hints_shuffle_no_row(spark):
    made = lambda rows, kind: spark.createDataFrame(rows, SCHEMAS[kind])
    places = made([(2, "red", "Second", "B", 1.0, 2.0), (1, "Steel  Ring", "First", "A", 3.0, 4.0), (3, "東京", "Tokyo", "J", 5.0, 6.0)], "places")
    aliases = made([(1, "blue", "C")], "aliases")
    hints = made([("desk", "local", "L"), ("desk", "deep", "D"), ("other", "deep", "O"), ("desk", "none", None)], "source_hints")
    rows = [(1, "a red steel-ring", "x", None, "F"), (2, "red blue", "x", None, "F"), (3, "今日東京で", "x", None, "F"), (4, "blue", "x", None, None), (5, "redder", "My Desk", "https://a.com/local/deep/1", "F"), (6, None, "desk", "https://a.com/Local/x/deep", "F"), (7, "", "desk", "https://a.com/none", "F"), (8, "", "x", "https://a.com/deep", "F"), (9, "", None, None, None)]
    table = spark.createDataFrame(rows, "id long, title string, source string, url string, country string")
    geo = lambda rows: classify.infer_geo(rows, "id", F.lower("title"), places, aliases, made([("A", 9.0, 9.0)], "countries"), "country", hints)
    got = {r.id: (r.geo_country, r.location, r.lat, r.decided_by) for r in geo(table).collect()}
    assert got == {1: ("A", "First", 3.0, "place"), 2: ("B", "Second", 1.0, "place"), 3: ("J", "Tokyo", 5.0, "place"), 4: ("C", "C", None, "country"), 5: ("D", "D", None, "hint"), 6: ("L", "L", None, "hint"), 7: (None, None, None, "hint"), 8: ("F", "F", None, "fallback"), 9: (None, None, None, "none")}
    many = spark.range(20_000).select(F.col("id"), F.concat(F.lit("red blue "), F.sha2(F.col("id").cast("string"), 256)).alias("title"), F.lit("desk").alias("source"), F.lit("https://a.com/local/x").alias("url"), F.lit("F").alias("country"))
    assert _shuffled(spark, geo(many)) < 20_000


def test_commonest_category_is_carried_once(spark):
    rows = spark.createDataFrame([("s", f"https://A.com:80/x/y/{k}", c) for k, c in enumerate("aabbbaccz")], "source string, url string, category string")
    learned = classify.learn_signature_categories(rows, 8, 0.3)
    assert sorted(tuple(r) for r in learned.collect()) == [("s", 0, "a.com/", "b", 9, 3), ("s", 1, "a.com/x", "b", 9, 3), ("s", 2, "a.com/x/y", "b", 9, 3)]
    words = classify.learn_token_categories(rows.withColumn("url", F.lit("https://a.com/story")), 5, 0.3)
    assert [tuple(r) for r in words.collect()] == [("s", "story", "b", 9)]
    empty = rows.select("source", "url").distinct()
    assert {tuple(r)[1:] for r in classify.predict_signature_categories(empty, learned, "url").collect()} == {("b", 2)}
    assert "max_by" not in _plan(learned) + _plan(words) + _plan(classify.predict_signature_categories(empty, learned, "url"))


def test_newest_copy_is_carried_once(spark):
    at = datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("a", at, "t", "u", "c"), ("a", at, "t", None, "d"), ("a", at - timedelta(hours=1), "z", "z", "z"), ("b", at, None, "u", None)], "external_id string, created_at timestamp_ntz, title_original string, url string, country string")
    newest = registry.incremental_export(rows, at - timedelta(hours=3), at + timedelta(hours=3))[0]
    assert sorted(tuple(r) for r in newest.collect()) == [("a", at, "t", "u"), ("b", at, None, "u")]
    assert "max_by" not in _plan(newest)


def test_ids_of_one_row_are_not_shuffled_whole(spark, monkeypatch):
    """The second merge of D2 and the newest rows of a kept table: the same rows, whether few ids repeat or too many for a broadcast."""
    at = datetime(2024, 1, 1)
    rows = [(f"e{k}", None if k % 3 else f"s{k // 2}", at, f"t{k}", "ok", ["b", "a"], f"{k:05}") for k in range(2_000)] + [("e1", "s9", at, "again", "recovered", ["c"], "z"), (None, "s7", at, "none", "ok", None, "y"), (None, "s8", at, "none", "ok", None, "x")]
    table = spark.createDataFrame(rows, "external_id string, stable_id string, publication_datetime timestamp_ntz, title_original string, title_quality string, tags array<string>, seen string").withColumn("title_original", F.concat("title_original", F.sha2("title_original", 512)))
    merged = lambda: merge.dedupe_articles(table, ["external_id", "stable_id", "publication_datetime", "title_original", "title_quality"], ["tags"])
    latest = lambda: merge.latest_of_kept(table, "external_id", ["seen"])
    found = [sorted(map(repr, rows().collect())) for rows in (merged, latest)]
    assert len(found[1]) == 2_001 and _shuffled(spark, merged()) < 10_000 and _shuffled(spark, latest()) < 10_000
    monkeypatch.setattr(kept, "MOST_REPEATED", 0)
    assert [sorted(map(repr, rows().collect())) for rows in (merged, latest)] == found
    assert sorted(map(repr, merge.latest_first(table, "external_id", ["seen"]).collect())) == found[1]


def test_an_export_shuffles_only_what_repeats(spark, tmp_path, monkeypatch):
    """Exact repeats are told once, copies and rows without values each, rows behind the overlap not; no state is kept beside what was told."""
    at = datetime(2024, 1, 1, 12)
    schema = "external_id string, created_at timestamp_ntz, title_original string, url string, country string"
    row = lambda k, hours=0, title="t": (None if k == 5 else f"e{k}", at + timedelta(hours=hours), title + str(k), None if k == 7 else f"https://a.com/{k * k:060}", "c")
    loads = [[row(k) for k in range(3_000)] + [row(3), row(5), row(7)], [row(k, 1) for k in range(3_000, 3_010)] + [row(3), row(5), row(7), row(8, 0, "new"), row(9, 5), row(9, 5), row(4, -4, "late"), row(4, -4, "late")], [row(9, 5), row(10, 1)]]
    found = []
    for most in (kept.MOST_REPEATED, 0):
        monkeypatch.setattr(kept, "MOST_REPEATED", most)
        feed, behind = registry.ExportFeed(spark, f"{tmp_path}/feed{most}", 3 * 3600), []
        for k, rows in enumerate(loads):
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in{most}/{k}")
            behind.append(feed.drain(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in{most}")))
        told = spark.read.parquet(f"{feed.folder}/rows").drop("batch")
        assert behind == [0, 2, 1] and told.count() == told.distinct().count() == 3_000 + 10 + 2
        assert feed.cursor() == at + timedelta(hours=5) and not (tmp_path / f"feed{most}" / "state" / "state").exists()
        found.append(sorted(map(repr, feed.rows().collect())))
        if most:
            assert _shuffled(spark, feed.rows()) < 10_000
    assert found[0] == found[1] and len(found[0]) == 3_010
