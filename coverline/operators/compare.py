"""Comparisons of feeds and of links with what they lead to."""

from __future__ import annotations

import heapq
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import at, present
from coverline.functions.components import components
from coverline.functions.titles import assess_title, clean_text
from coverline.functions.urls import article_id, host_of
from coverline.operators.merge import tokens
from coverline.sources.kept import keep
from coverline.sources.rules import small


#: The network of sources that belong to none.
NO_NETWORK = "independent"


BOTH = ["network", "candidate"]


def _known(rows: DataFrame, current: DataFrame, c: str) -> DataFrame:
    """``rows`` with known: whether a current source has their value of ``c``."""
    return rows.join(current.select(c).distinct().withColumn("known", F.lit(True)), c, "left")


def _counts(rows: DataFrame, n: str, has: str, weight: Column | int = 1) -> DataFrame:
    each = F.lit(weight) if isinstance(weight, int) else weight
    return rows.groupBy(*BOTH).agg(F.sum(each).cast("long").alias(n), F.sum(F.when(F.col("known"), each).otherwise(0)).cast("long").alias(has))


def _distinct(items: DataFrame, c: str) -> DataFrame:
    return items.select(*BOTH, c).where(F.col(c).isNotNull()).distinct()


def _totals(items: DataFrame, current: DataFrame, titles: DataFrame) -> DataFrame:
    """The totals of each candidate, from its items and the counts of its titles."""
    links = _counts(_known(_distinct(items, "link"), current, "link"), "n_links", "overlap")
    totals = items.groupBy(*BOTH).agg(F.count("*").alias("n_items")).join(titles, BOTH, "left").join(links, BOTH, "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in ("n_titles", "title_overlap", "n_links", "overlap")}
    return totals.withColumns(zeros).withColumns({"new_titles": F.col("n_titles") - F.col("title_overlap"), "new_links": F.col("n_links") - F.col("overlap")})


def candidate_totals(items: DataFrame, current: DataFrame) -> DataFrame:
    """Per candidate source: items, distinct titles and links, and how many of them current sources have."""
    return _totals(items, current, _counts(_known(_distinct(items, "title"), current, "title"), "n_titles", "title_overlap"))


def _holders(titles: DataFrame) -> DataFrame:
    """Of rows of (network, candidate, title) a row for each title of a network with the candidates that have it."""
    return titles.groupBy("network", "title").agg(F.array_sort(F.collect_set("candidate")).alias("who"))


def _numbered(totals: DataFrame) -> DataFrame:
    """With tie, the place of a candidate among those of its network that add as much, and node, its number."""
    tie = F.row_number().over(Window.partitionBy("network").orderBy(F.desc("new_titles"), F.desc("n_items"), "candidate"))
    return keep(totals.withColumn("tie", tie).withColumn("node", F.monotonically_increasing_id()), "totals")


def candidate_lift(items: DataFrame, current: DataFrame) -> DataFrame:
    """``candidate_totals``, and what each candidate adds in greedy order within its network.

    ``items`` has network, candidate, title and link, a row an item; ``current`` title and link. In a network of two or more the candidate
    that adds most new titles comes first (then more new titles in all, more items, the smaller name); ``lift`` is what it adds after those
    before it, ``penalty`` the new titles that these already brought. Others have all their new titles for lift, and no place.

    Titles that the same candidates of a network have count alike, so they are one set of candidates with their number; all
    that follows is over sets, and over numbers for candidates. Candidates that share no title, not even through others, do
    not change what each other adds, so the order is found in each class of candidates that do. A class of up to
    ``MOST_OPEN`` rows is ordered by one task. In a larger one, a candidate that comes before all who share a title with it
    that is still open is chosen by the greedy order before any of these, so what it adds is settled; all such candidates are
    settled at once, their titles closed, and the rest counted again, until what is open falls to that bound. No task holds more.
    """
    titles = _known(_holders(items.where("title is not null")), current, "title")
    sets = keep(titles.groupBy("network", "known", "who").agg(F.count("*").alias("n")).withColumn("set_id", F.monotonically_increasing_id()), "sets")
    totals = _totals(items, current, _counts(sets.select("network", "known", "n", F.explode("who").alias("candidate")), "n_titles", "title_overlap", F.col("n")))
    sizes = totals.where(F.col("network") != NO_NETWORK).groupBy("network").agg(F.count("*").alias("n")).where("n > 1").select("network", F.lit(True).alias("ranked"))
    totals = _numbered(totals.join(sizes, "network", "left"))
    out = totals.join(_lifts(sets.where("known is null"), totals.where("ranked")), "node", "left").drop("node")
    out = out.withColumn("lift", F.when(F.col("ranked"), F.coalesce("lift", F.lit(0))).otherwise(F.col("new_titles")))
    place = F.row_number().over(Window.partitionBy("ranked", "network").orderBy(F.desc("lift"), "tie"))
    return out.withColumns({"penalty": F.col("new_titles") - F.col("lift"), "place": F.when(F.col("ranked"), place).cast("long")}).drop("ranked", "tie")


#: Rows (a candidate's open set of titles, in four numbers) of a class that one task orders.
MOST_OPEN = 4_000_000


def _settled_lifts(open_titles: DataFrame, most: int = MOST_OPEN) -> DataFrame:
    """(network, candidate, lift) from rows of (network, candidate, title, new_titles, n_items)."""
    sets = _holders(open_titles).groupBy("network", "who").agg(F.count("*").alias("n")).withColumn("set_id", F.monotonically_increasing_id())
    totals = _numbered(open_titles.select(*BOTH, "new_titles", "n_items").distinct())
    return totals.join(_lifts(keep(sets, "sets"), totals, most), "node").select(*BOTH, "lift")


def _lifts(sets: DataFrame, totals: DataFrame, most: int = MOST_OPEN) -> DataFrame:
    """(node, lift) from sets of candidates that have ``n`` open titles together, and the candidates' nodes and order in ties."""
    rows = sets.select("network", "set_id", "n", F.explode("who").alias("candidate")).join(totals.select(*BOTH, "node", "tie"), BOTH).select("set_id", "node", "tie", "n")
    rows = keep(rows, "rows")
    links = rows.groupBy("set_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("b")).select("a", F.explode("b").alias("b")).distinct()
    settled, left = [], keep(rows.join(components(links), "node"), "open")
    while True:
        large = left.groupBy("class_id").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("class_id")
        settled.append(keep(left.join(large, "class_id", "left_anti").groupBy("class_id").applyInPandas(_ordered, "node long, lift long"), "chosen"))
        left = keep(left.join(large, "class_id", "left_semi"), "open")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        chosen, left = _settle_round(left)
        settled.append(chosen)


def _settle_round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates that come before all who share an open title with them, and the rows that are open after these."""
    gains = left.groupBy("node").agg(F.sum("n").alias("gain"), F.struct((-F.sum("n")).alias("gain"), F.first("tie").alias("tie")).alias("order"))
    keyed = left.join(gains, "node")
    first = keyed.groupBy("set_id").agg(F.min("order").alias("first"))
    chosen = keep(keyed.join(first, "set_id").groupBy("node").agg(F.bool_and(F.col("order") == F.col("first")).alias("all"), F.max("gain").alias("lift")).where("all").select("node", "lift"), "chosen")
    closed = left.join(chosen.select("node"), "node", "left_semi").select("set_id").distinct()
    return chosen, keep(left.join(closed, "set_id", "left_anti"), "open")


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """What each candidate of one class adds, in greedy order; those that add nothing are left out."""
    names = rows[["node", "tie"]].drop_duplicates("node").sort_values("tie", ignore_index=True)
    who = np.searchsorted(names["tie"].to_numpy(), rows["tie"].to_numpy())
    what = pd.factorize(rows["set_id"])[0]
    sizes = np.zeros(what.max() + 1, np.int64)
    sizes[what] = rows["n"].to_numpy()
    sets_of = np.split(what[np.argsort(who, kind="stable")], np.cumsum(np.bincount(who))[:-1])
    ends = np.cumsum(np.bincount(what))
    holders, is_open, gain = who[np.argsort(what, kind="stable")], np.ones(len(ends), bool), np.zeros(len(names), np.int64)
    np.add.at(gain, who, sizes[what])
    # gains only fall, so a candidate whose gain still holds when it comes up is the first
    heap, lifts = [(-g, k) for k, g in enumerate(gain.tolist())], np.zeros(len(gain), np.int64)
    heapq.heapify(heap)
    while heap:
        g, k = heapq.heappop(heap)
        if -g != gain[k]:
            if gain[k]:
                heapq.heappush(heap, (-int(gain[k]), k))
            continue
        lifts[k] = gain[k]
        closed = sets_of[k][is_open[sets_of[k]]]
        is_open[closed] = False
        counts = np.diff(ends, prepend=0)[closed]
        at_holder = np.repeat(ends[closed] - np.cumsum(counts), counts) + np.arange(counts.sum())
        np.subtract.at(gain, holders[at_holder], np.repeat(sizes[closed], counts))
    return pd.DataFrame({"node": names["node"], "lift": lifts})[lifts > 0]


def link_kind(url: Column) -> Column:
    """What a link leads to by its words: a video, photos, something like an article, or other."""
    lower = F.lower(url)
    path = F.regexp_extract(lower, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    words = lambda *names: lower.rlike("(^|[^a-z])(" + "|".join(names) + ")([^a-z]|$)")
    return F.when(words("video", "videos", "videogallery", "videoarticle"), "video").when(words("photo", "photos", "foto", "fotos", "photogallery", "gallery"), "photo").when(path.rlike("[a-z]+-[a-z]+|[0-9]{4,}"), "article").otherwise("other")


def variant_audit(links: DataFrame, variant: Column) -> DataFrame:
    """Per variant feed: links, those that no other feed of the same country and host has, of which kinds these are, and what to do with it."""
    marked = links.withColumns({"host": host_of(F.col("url")), "is_variant": variant})
    plain = marked.where(~F.col("is_variant")).select("country", "host", "url").distinct()
    alone = marked.where("is_variant").select("feed", "country", "host", "url").distinct()
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("article", "photo", "video", "other")]
    unique = alone.join(plain, ["country", "host", "url"], "left_anti").withColumn("kind", link_kind(F.col("url"))).groupBy("feed").agg(F.count("*").alias("n_unique"), *kinds)
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_unique", "n_article", "n_photo", "n_video", "n_other")}
    out = alone.groupBy("feed").agg(F.count("*").alias("n_links")).join(unique, "feed", "left").withColumns(counts)
    return out.withColumn("recommendation", F.when(F.col("n_unique") == 0, "drop").when(F.col("n_unique") * 2 < F.col("n_links"), "review").otherwise("keep"))


def redirect_audit(fetched: DataFrame) -> DataFrame:
    """Why a fetched link is no article any more, how far its titles agree, and whether it is safe to prune."""
    path = F.regexp_extract("final_url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    a, b = tokens(F.col("title"), 3), tokens(F.col("page_title"), 3)
    overlap = F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)), 4)).otherwise(0.0)
    moved = F.col("final_url") != F.col("url")
    reason = F.when(F.col("status") >= 400, "http_error").when(moved & path.rlike("^/*$"), "redirected_home").when(moved & path.rlike("^/[^/]+/?$"), "redirected_section").when(F.size(F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")) < 2, "shallow_path").when(F.col("overlap") < 0.3, "title_mismatch").otherwise("ok")
    out = fetched.withColumn("overlap", overlap).withColumn("reason", reason)
    return out.withColumn("safe_prune", F.col("reason").isin("http_error", "redirected_home") | ((F.col("reason") == "redirected_section") & (F.col("overlap") < 0.3)))


def non_article_urls(rows: DataFrame, rules: DataFrame, column: str = "url") -> DataFrame:
    """Rows that no deny rule meets; rules are (host_suffix, source_part or null, path_pattern).

    Every suffix of a link's host is looked up, so rules join on equality and only a host's own rules are tried.
    """
    host = host_of(F.col(column))
    labels = F.split(host, "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1000), "."))
    keyed = rows.withColumns({"__suffixes": suffixes, "__path": F.regexp_extract(F.col(column), r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)})
    probes = keyed.select(F.col(column).alias("u"), "source", "__path", F.explode("__suffixes").alias("host_suffix")).distinct()
    fits = probes.join(small(rules), "host_suffix").where((F.col("source_part").isNull() | F.contains(F.lower("source"), F.col("source_part"))) & F.expr("__path rlike path_pattern"))
    denied = fits.select("u", F.col("source").alias("s")).distinct()
    return rows.join(denied, (F.col(column) == F.col("u")) & F.col("source").eqNullSafe(F.col("s")), "left_anti")


def visible_articles(articles: DataFrame, as_of: datetime, hours: int = 48, countries: tuple = (), sections: tuple = (), text: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of what readers see, newest first, each row with the number of all."""
    rows = articles.where((F.coalesce(present("title_quality"), F.lit("ok")) != "suspect") & (F.col("publication_datetime") <= at(as_of)) & (F.col("publication_datetime") >= at(as_of - timedelta(hours=hours))))
    if countries:
        rows = rows.where(F.col("country").isin(*countries))
    if sections:
        rows = rows.where(F.col("primary_section").isin(*sections))
    if text:
        like = F.lit(f"%{text}%")
        rows = rows.where(F.ilike("title_original", like) | F.ilike("source", like) | F.ilike("country", like) | F.exists("feed_categories", lambda c: F.ilike(c, like)))
    page = rows.orderBy(F.desc("publication_datetime"), F.desc("created_at"), "external_id", "title_original").offset(offset).limit(limit)
    return page.select("external_id", "title_original", "source", "publication_datetime", rows.agg(F.count("*")).scalar().alias("total_count"))


def filter_values(articles: DataFrame) -> DataFrame:
    """Distinct countries, sections and sources."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), present(c).alias("value")) for k, c in (("country", "country"), ("section", "primary_section"), ("source", "source")))))
    return articles.select(kinds.alias("x")).select("x.*").where("value is not null").distinct()


def clamp_publication(items: DataFrame, as_of: datetime, max_age_days: int = 14, ahead_hours: int = 24) -> DataFrame:
    """Publication never after ingestion, ingestion where there is none; too old and too far ahead are dropped."""
    stated = F.col("published_at")
    kept = items.where(stated.isNull() | (stated <= at(as_of + timedelta(hours=ahead_hours))))
    clamped = kept.withColumn("publication_datetime", F.least(F.coalesce(stated, F.col("ingested_at")), F.col("ingested_at")))
    return clamped.where(F.col("publication_datetime") >= at(as_of - timedelta(days=max_age_days)))


def persistable_rows(items: DataFrame, as_of: datetime) -> DataFrame:
    """What the store takes of items: id, cleaned texts, judged title, clamped time; without link or title they are dropped."""
    rows = clamp_publication(items, as_of)
    judged = rows.withColumn("t", assess_title(F.col("title"), F.col("link")))
    out = judged.select(article_id(F.col("link")).alias("external_id"), "stable_id", F.col("link").alias("url"), F.col("t.normalized").alias("title_original"), F.col("t.quality").alias("title_quality"), F.col("t.reason").alias("title_quality_reason"), clean_text(F.col("description"), 500).alias("snippet_original"), "publication_datetime", "source")
    return out.where((F.coalesce("url", F.lit("")) != "") & (F.col("title_original") != ""))
