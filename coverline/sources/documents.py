"""Raw documents: feeds, sitemaps and pages taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import let
from coverline.functions.dates import parse_loose_date
from coverline.functions.titles import clean_text, decode_entities
from coverline.functions.urls import date_in_link, feed_stable_id, host_of


def _inner(block: Column, tag: str) -> Column:
    """Text of the first element of a name, character data unwrapped; null where there is none."""
    found = F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return let(F.trim(F.regexp_replace(found, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), lambda t: F.when(t != "", t))


def parse_feeds(raw: DataFrame, limit: int | None = 100) -> DataFrame:
    """Items of RSS, else entries of Atom documents (url, body): the first ``limit`` of each, or all."""
    items = F.regexp_extract_all("body", F.lit(r"(?is)(<item[\s>].*?</item>)"), F.lit(1))
    entries = F.regexp_extract_all("body", F.lit(r"(?is)(<entry[\s>].*?</entry>)"), F.lit(1))
    blocks = F.when(F.size(items) > 0, items).otherwise(entries)
    blocks = blocks if limit is None else F.slice(blocks, 1, limit)
    rows = raw.select("url", F.posexplode(blocks).alias("place", "block"))
    href = F.nullif(F.regexp_extract("block", r"(?is)<link[^>]*\bhref=[\"']([^\"']+)", 1), F.lit(""))
    rows = rows.withColumn("link", decode_entities(F.coalesce(_inner(F.col("block"), "link"), href)))
    link = F.col("link")
    guid = F.coalesce(_inner(F.col("block"), "guid"), _inner(F.col("block"), "id"))
    dates = [parse_loose_date(_inner(F.col("block"), t)) for t in ("pubDate", "published", "date", "updated", "dc:date")]
    named = F.filter(F.transform(F.regexp_extract_all("block", F.lit(r"(?is)<category[^>]*>(.*?)</category>"), F.lit(1)), lambda c: clean_text(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), 200)), lambda c: c != "")
    terms = F.regexp_extract_all("block", F.lit(r"(?is)<category[^>]*\bterm=[\"']([^\"']+)"), F.lit(1))
    return rows.select(
        "url", "place", clean_text(_inner(F.col("block"), "title"), 500).alias("title"), link.alias("link"), clean_text(F.regexp_replace(decode_entities(F.coalesce(_inner(F.col("block"), "description"), _inner(F.col("block"), "summary"), F.lit(""))), "<[^>]+>", " "), 2000).alias("description"),
        F.array_distinct(F.concat(named, terms)).alias("categories"), feed_stable_id(guid, link).alias("stable_id"), F.coalesce(*dates, date_in_link(link).cast("timestamp")).alias("published_at"),
    )


def parse_sitemaps(raw: DataFrame, limit: int = 100) -> DataFrame:
    """Links of sitemaps (url, body) on the document's own host, newest first, undated last; the first ``limit`` of each."""
    rows = raw.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)(<url[\s>].*?</url>)"), F.lit(1))).alias("place", "block"))
    link = decode_entities(_inner(F.col("block"), "loc"))
    date = parse_loose_date(F.coalesce(_inner(F.col("block"), "news:publication_date"), _inner(F.col("block"), "lastmod")))
    rows = rows.select("url", "place", link.alias("link"), clean_text(_inner(F.col("block"), "news:title"), 500).alias("title"), date.alias("published_at"))
    site = lambda c: F.regexp_replace(host_of(c), "^www[.]", "")
    kept = rows.where(F.col("link").isNotNull() & (site(F.col("link")) == site(F.col("url"))))
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc_nulls_last("published_at"), "place"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit)


def feed_item_stats(items: DataFrame) -> DataFrame:
    """Per document: items, valid ones, and how many lack a title, description, date or link."""
    lacks = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    valid = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
    return items.groupBy("url").agg(F.count("*").alias("total"), F.count_if(valid).alias("valid"), lacks("title").alias("missing_title"), lacks("description").alias("missing_summary"), lacks("published_at").alias("missing_published_at"), lacks("link").alias("missing_link"))


def page_title(html: Column) -> Column:
    """og:title, else the title meta tag, else the title element."""
    meta = lambda name: F.nullif(F.regexp_extract(html, rf"(?is)<meta[^>]+(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)", 1), F.lit(""))
    return clean_text(F.coalesce(meta("og:title"), meta("title"), _inner(html, "title")), 500)


#: How deep structured data is looked into.
MOST_DEPTH = 8
LD_JSON = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"


def _members(v: Column) -> Column:
    """An object's members by name; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def with_json_objects(rows: DataFrame, texts: str, name: str) -> DataFrame:
    """``rows`` with a column of every object of a list of JSON texts as maps of VARIANT: depth first, an object before what it holds, members in the order of their names.

    Broken JSON holds none, and what lies more than ``MOST_DEPTH`` objects and arrays deep is left out. Each level is a column of
    its own, with the place of every value, which sorts them at the end.
    """
    place = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    none = F.array().cast("array<variant>")

    def below(node: Column) -> Column:
        values = F.concat(F.coalesce(F.map_values(_members(node.v)), none), F.coalesce(F.try_variant_get(node.v, "$", "array<variant>"), none))
        return F.transform(values, lambda v, k: place(F.concat(node.path, F.array(k)), v))

    levels = [f"__level{k}" for k in range(MOST_DEPTH + 1)]
    out = rows.withColumn(levels[0], F.transform(texts, lambda t, k: place(F.array(k), F.try_parse_json(t))))
    for level, further in zip(levels, levels[1:]):
        out = out.withColumn(further, F.flatten(F.transform(level, below)))
    inside = F.filter(F.concat(*levels), lambda n: _members(n.v).isNotNull())
    ordered = F.array_sort(inside, lambda a, b: F.when(a.path < b.path, -1).when(a.path > b.path, 1).otherwise(0))
    return out.withColumn(name, F.transform(ordered, lambda n: _members(n.v))).drop(*levels)


def _strings(v: Column) -> Column:
    """A text, or the texts of a list, of a VARIANT."""
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    none = F.array().cast("array<string>")
    listed = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), is_text), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(is_text(v), F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.coalesce(listed, none))


def _breadcrumbs(members: Column) -> Column:
    """Names of a breadcrumb list between its first, the site, and its last, the page."""
    name = lambda item: F.coalesce(F.get(_strings(F.try_element_at(item, F.lit("name"))), 0), F.get(_strings(F.try_element_at(_members(F.try_element_at(item, F.lit("item"))), F.lit("name"))), 0))
    items = F.try_variant_get(F.try_element_at(members, F.lit("itemListElement")), "$", "array<variant>")
    names = F.filter(F.transform(items, lambda x: name(_members(x))), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    inner = let(names, lambda x: F.when(F.size(x) >= 3, F.slice(x, 2, F.size(x) - 2)).when(F.size(x) == 2, F.slice(x, 2, 1)))
    is_list = F.exists(_strings(F.try_element_at(members, F.lit("@type"))), lambda t: F.lower(t) == "breadcrumblist")
    return F.when(is_list, inner)


def signal(text: Column) -> Column:
    """A category's text: cleaned, without dashes, bars and arrows around it, at most 160 characters; empty for null."""
    return F.substring(F.trim(F.regexp_replace(clean_text(F.regexp_replace(text, "<[^>]+>", " "), 10_000), r"^[-|/>\s]+|[-|/>\s]+$", "")), 1, 160)


def with_categories(pages: DataFrame, html: str = "html", name: str = "categories", most: int = 24) -> DataFrame:
    """``pages`` with their categories: section meta, sections and breadcrumbs of structured data, breadcrumb links, keywords, in that order; lists in one text taken apart, distinct.

    Structured data is walked as a tree (``with_json_objects``); a broken script still tells the sections that its text shows.
    """
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    none = F.array().cast("array<string>")
    meta = every(r"(?is)<meta[^>]+(?:property|name)=[\"']article:section[\"'][^>]*content=[\"']([^\"']*)")
    words = every(r"(?is)<meta[^>]+name=[\"'](?:news_)?keywords[\"'][^>]*content=[\"']([^\"']*)")
    crumbs = F.flatten(F.transform(every(r"(?is)<(?:nav|ol|ul)[^>]*breadcrumb[^>]*>(.*?)</(?:nav|ol|ul)>"), lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1))))
    scripts = F.transform(every(LD_JSON), lambda t: F.trim(F.regexp_replace(t, r"^\s*<!--|-->\s*$", "")))
    out = with_json_objects(pages.withColumn("__scripts", scripts), "__scripts", "__objects")
    of = lambda key: F.flatten(F.transform("__objects", lambda m: _strings(F.try_element_at(m, F.lit(key)))))
    shown = F.flatten(F.transform("__scripts", lambda t: F.regexp_extract_all(t, F.lit(r"(?i)\"articleSection\"\s*:\s*\"([^\"]+)\""), F.lit(1))))
    trail = F.flatten(F.transform("__objects", lambda m: F.coalesce(_breadcrumbs(m), none)))
    out = out.withColumn("__found", F.concat(meta, of("section"), of("contentSection"), of("articleSection"), shown, trail, crumbs, words, of("keywords")))
    out = out.withColumn("__signals", F.transform("__found", signal))
    pieces = lambda x: F.filter(F.transform(F.split(x, r"\s*[,;|>›»]\s*"), lambda p: F.trim(F.regexp_replace(p, r"^[-|/>\s]+|[-|/>\s]+$", ""))), lambda p: p != "")
    out = out.withColumn("__pieces", F.transform("__signals", lambda x: F.struct(x.alias("x"), pieces(x).alias("p"))))
    clean = F.filter(F.flatten(F.transform("__pieces", lambda s: F.when(F.size(s.p).between(2, 12), s.p).otherwise(F.array(s.x)))), lambda c: c != "")
    return out.withColumn(name, F.slice(F.array_distinct(clean), 1, most)).drop("__scripts", "__objects", "__found", "__signals", "__pieces")


def navigation_labels(html: Column, most: int = 24) -> Column:
    """Labels of a page's navigation links, for pages that state no category."""
    nav = F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1)
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), lambda c: F.trim(c))), 1, most)
