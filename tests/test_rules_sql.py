"""SQL states the whole rule of its query, also over texts that the small tables lack."""

from __future__ import annotations

import duckdb

from coverline.plans import news
from coverline.plans.views import RUNS_AS_OF, feeds, runs


def _same(spark, folder, name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = news.QUERIES[name](spark, folder)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    found = con.sql(news.SQL[name])
    at = [list(found.columns).index(c) for c in sorted(df.columns)]
    assert got == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())
    return df


def test_words_of_any_script(spark, tmp_path):
    """A letter outside a to z parts no word."""
    rows = ["x undßgeber", "the end", "ｔｈｅ ½", "théß the", "жthe", "a,und.b", "Úñd", "of²", "it's", "", None]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.section for r in _same(spark, str(tmp_path), "c1_classify_keyword", "documents").collect()}
    assert got[0] == got[4] == got[10] == "others" and got[1] == got[2] == "politics"


def test_entities_and_low_titles_of_pages(spark, tmp_path):
    title = ["t = &quot;5&quot;", "a &amp;amp;lt; b", "&#233;t&#xE9; &#38;amp;", "News", "123456", "q &nbsp; &unknown; &", "", "photo.jpg", "https://x.y"]
    link = ["https://a.b/c", "https://a.b/one-two-three-1234-four.html", "https://a.b/news/2024"]
    rows = [(5 * k + r, link[(k + r) % 3], f"<html><title lang='x'> {t}\n</title></html>") for k, t in enumerate(title) for r in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.reason, r.readable) for r in _same(spark, str(tmp_path), "n8_assess_title", "pages").collect()}
    assert got[2] == ("feed_title_ok", 't = "5"') and got[12] == ("feed_title_ok", "été &") and {r for r, _ in got.values()} >= {"recovered_from_link", "low_signal_title", "missing_title"}


def test_every_attempt_counts_as_a_check(spark, small):
    enabled = {r.outlet_id for r in feeds(spark, small).where("enabled").collect()}
    rows = [r for r in runs(spark, small).collect() if r.attempted and (RUNS_AS_OF - r.ran_at).total_seconds() <= 48 * 3600 and r.outlet_id in enabled]
    got = {(r.country, r.source) for r in news.QUERIES["a14_checked_sources"](spark, small).collect()}
    assert got == {(r.country, r.source) for r in rows} > {(r.country, r.source) for r in rows if r.id % 5 < 2}
