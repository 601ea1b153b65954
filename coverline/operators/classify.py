"""Rules as tables: sections, topics, places and publishers of articles.

Rule tables come from files (``sources.rules``) or from the caller; none is built in.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coverline.functions.columns import SECTIONS, let, present, section_rank, since
from coverline.functions.folding import fold_text
from coverline.functions.matcher import finder, first_found, pattern_matches
from coverline.functions.urls import host_of
from coverline.sources.rules import MOST_RULES, SCHEMAS, small

#: Confidence of a match of a text in the first and second tier, and of none.
HIGH, MEDIUM, FALLBACK = 0.84, 0.72, 0.51
#: Confidence of a feed's category by name, by a keyword of either tier, and of categories that say nothing.
BY_NAME, CATEGORY_HIGH, CATEGORY_MEDIUM, CATEGORY_FALLBACK = 0.90, 0.86, 0.75, 0.55
#: Least confidence of a keyword in source and link, of a structured hint, and of a source's own section.
HINT_KEYWORD, STRUCTURED, SOURCE_FALLBACK = 0.68, 0.66, 0.64


def keyword_table(spark: SparkSession, rules: tuple) -> DataFrame:
    """(tier, keyword, section) in order as a rule table."""
    return spark.createDataFrame([(k, *rule) for k, rule in enumerate(rules)], SCHEMAS["keywords"])


#: What separates words of any script; keywords in scripts that put no spaces between words are met anywhere in a text.
APART = r"[^\p{L}\p{M}\p{N}]+"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"


def _pieces(of: Column, lengths: list[int], mark: str) -> Column:
    """Distinct runs of so many parts of a value that is computed once."""
    run = lambda x, n: F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), mark))
    none = F.array().cast("array<string>")
    return let(of, lambda x: F.array_distinct(F.concat(none, *(F.when(F.size(x) >= n, run(x, n)).otherwise(none) for n in lengths))))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, APART), lambda w: w != "")


def _whole(text: Column) -> Column:
    """Words with one space around each."""
    return F.concat(F.lit(" "), F.regexp_replace(text, APART, " "), F.lit(" "))


def _keywords(rules: DataFrame) -> DataFrame:
    """``rules`` with folded keywords, those of several words with single spaces, and whether a keyword is met anywhere in a text."""
    own = rules.withColumn("keyword", fold_text("keyword")).withColumn("unspaced", F.col("keyword").rlike(UNSPACED))
    return own.withColumn("keyword", F.when(F.col("unspaced"), F.col("keyword")).otherwise(F.array_join(_words(F.col("keyword")), " "))).where("keyword <> ''")


def first_rule(rows: DataFrame, id_column: str, folded: Column, rules: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``columns`` of the first rule by priority whose keyword the text holds (as ``matches`` has it); null where there is none.

    The automaton gives each row its rule, so that no row is shuffled; beyond ``MOST_RULES`` rules matches are joined by id.
    """
    known = _keywords(rules).where("priority is not null").select("keyword", "unspaced", "priority", *columns)
    listed = known.limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        best = matches(rows, id_column, folded, rules).groupBy("id").agg(F.min_by(F.struct(*columns), "priority").alias("x"))
        return rows.join(best.select(F.col("id").alias(id_column), "x.*"), id_column, "left")
    listed.sort(key=lambda r: (r.priority, r.keyword))
    number = first_found([f" {r.keyword} " if not r.unspaced else "" for r in listed])(_whole(folded))
    if any(r.unspaced for r in listed):
        number = F.least(number, first_found([r.keyword if r.unspaced else "" for r in listed])(folded))
    schema = "__rule int, " + ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in columns)
    numbered = rows.sparkSession.createDataFrame([(k, *(r[c] for c in columns)) for k, r in enumerate(listed)], schema)
    return rows.withColumn("__rule", number).join(F.broadcast(numbered), "__rule", "left").drop("__rule")  # at most MOST_RULES


def matches(rows: DataFrame, id_column: str, folded: Column, rules: DataFrame) -> DataFrame:
    """(id, columns of the rule) of every rule whose keyword a text holds, as whole words or, in unspaced scripts, anywhere.

    One automaton of all keywords reads each text once, and what it finds meets the rule table by equality. Beyond
    ``MOST_RULES`` keywords the text's runs of as many words (characters) as some rule has meet the table instead, so that no
    task holds all rules. ``rules`` has keyword and whatever else a rule says.
    """
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    base = rows.select(F.col(id_column).alias("id"), folded.alias("text"))
    own = _keywords(rules)
    spaced = own.where(~F.col("unspaced")).drop("unspaced")
    unspaced = own.where("unspaced").drop("unspaced")

    def met(base: DataFrame, table: DataFrame, text: Column, parts, mark: str, edge: str) -> DataFrame:
        known = [r.keyword for r in table.select("keyword").distinct().limit(MOST_RULES + 1).collect()]
        if len(known) <= MOST_RULES:
            found = base.select("id", F.explode(finder([f"{edge}{k}{edge}" for k in known])(text)).alias("keyword"))
            return found.withColumn("keyword", F.trim("keyword") if edge else F.col("keyword")).join(small(table), "keyword")
        sized = table.withColumn("n", F.size(parts(F.col("keyword"))))
        lengths = sorted(r.n for r in sized.select("n").distinct().collect())  # of keywords, a handful
        return base.select("id", F.explode(_pieces(parts(F.col("text")), lengths, mark)).alias("keyword")).join(small(table), "keyword")

    found = met(base, spaced, _whole(F.col("text")), _words, " ", " ")
    if unspaced.isEmpty():
        return found
    return found.unionByName(met(base.where(F.col("text").rlike(UNSPACED)), unspaced, F.col("text"), letters, "", ""))


def _first(found: DataFrame, high: float, medium: float) -> DataFrame:
    """(id, section, confidence) of the first rule in order, all of the first tier before the second."""
    order = F.struct(F.col("tier") != "high", F.col("priority"))
    best = found.groupBy("id").agg(F.min_by(F.struct("section", "tier"), order).alias("x"))
    return best.select("id", "x.section", F.when(F.col("x.tier") == "high", F.lit(high)).otherwise(F.lit(medium)).alias("confidence"))


def classify_keyword(rows: DataFrame, id_column: str, folded: Column, rules: DataFrame) -> DataFrame:
    """``rows`` with section and confidence; without a match "others" at the fallback's confidence."""
    found = _first(matches(rows, id_column, folded, rules), HIGH, MEDIUM).withColumnRenamed("id", id_column)
    return rows.join(found, id_column, "left").withColumns({"section": F.coalesce("section", F.lit("others")), "confidence": F.coalesce("confidence", F.lit(FALLBACK))})


def map_category(category: Column, exact: dict[str, str], parts: tuple) -> Column:
    """Section of a category: by its whole name, else by the first part it holds; null where nothing fits."""
    name = F.lower(F.trim(category))
    table = F.create_map(*(F.lit(x) for kv in exact.items() for x in kv)) if exact else F.create_map().cast("map<string,string>")
    out = F.lit(None).cast("string")
    for part, section in reversed(parts):
        out = F.when(F.contains(name, F.lit(part)), section).otherwise(out)
    return F.coalesce(F.element_at(table, name), out)


def category_sections(categories: DataFrame, exact: dict[str, str], parts: tuple, keywords: DataFrame) -> DataFrame:
    """(category, section, confidence) of the distinct categories that say something: by name, else by a keyword in them."""
    named = categories.select("category").distinct().withColumn("by_name", map_category(F.col("category"), exact, parts))
    found = _first(matches(named.where("by_name is null"), "category", fold_text("category"), keywords), CATEGORY_HIGH, CATEGORY_MEDIUM)
    both = named.join(found.withColumnRenamed("id", "category"), "category", "left")
    return both.select("category", F.coalesce("by_name", "section").alias("section"), F.when(F.col("by_name").isNotNull(), F.lit(BY_NAME)).otherwise(F.col("confidence")).alias("confidence")).where("section is not null")


def classify_by_categories(rows: DataFrame, id_column: str, column: str, table: DataFrame) -> DataFrame:
    """(id, section, confidence) of the first category of a row that ``table`` knows; of rows whose categories say nothing "others".

    Rows without categories are left out. ``table`` comes from ``category_sections``: categories, not articles, meet the rules.
    """
    listed = rows.select(F.col(id_column).alias("id"), F.posexplode(column).alias("place", "category"))
    best = listed.join(table, "category", "left").groupBy("id").agg(F.min_by(F.struct("section", "confidence"), F.when(F.col("section").isNotNull(), F.col("place"))).alias("x"))
    return best.select(F.col("id").alias(id_column), F.coalesce("x.section", F.lit("others")).alias("section"), F.coalesce("x.confidence", F.lit(CATEGORY_FALLBACK)).alias("confidence"))


def structured_hint(source: Column, url: Column, hints: tuple) -> Column:
    """Section of the first (part, section) that a source's name or link holds."""
    text = F.lower(F.concat_ws(" ", source, F.regexp_replace(url, r"(?i)^https?://(www\.)?|\.(html?|php)\b|utm_[a-z]+=[^&]*", "")))
    out = F.lit(None).cast("string")
    for part, section in reversed(hints):
        out = F.when(F.contains(text, F.lit(part)), section).otherwise(out)
    return out


def classify_section(category: Column, keyword: Column, hint_keyword: Column, structured: Column, fallback: Column) -> Column:
    """The most confident of a title's keyword, the categories and the context of source and link; the earlier of equals.

    The first three are structs of section and confidence (null where there is none), the others sections. A keyword in
    source and link counts at least ``HINT_KEYWORD``; a context of "others" says nothing.
    """
    said = lambda section: section.isNotNull() & (section != "others")
    options = [
        (F.coalesce(keyword.section, F.lit("others")), F.coalesce(keyword.confidence, F.lit(FALLBACK))), (category.section, F.when(category.section.isNotNull(), category.confidence)),
        (hint_keyword.section, F.when(said(hint_keyword.section), F.greatest(hint_keyword.confidence, F.lit(HINT_KEYWORD)))),
        (structured, F.when(said(structured), F.lit(STRUCTURED))), (fallback, F.when(said(fallback), F.lit(SOURCE_FALLBACK))),
    ]
    listed = F.array(*(F.struct(F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.lit(-k).alias("order"), section.alias("section")) for k, (section, confidence) in enumerate(options)))
    return F.array_max(listed)


#: What each kind of evidence adds to a section's score.
WEIGHTS = {"override": 0.95, "profile": 0.85, "feed_category": 0.55, "fallback": 0.5, "structured": 0.45, "title": 0.35, "context": 0.3, "hint": 0.25, "snippet": 0.2, "stored": 0.1}
#: The score from which a section takes the place of an override that says "others".
RECOVERED_FROM = {"politics": 0.7, "tech": 0.7, "business": 0.65, "conflicts": 0.65, "sports": 0.65, "health": 0.65, "entertainment": 0.65, "arts": 0.6, "lifestyle": 0.55}


def build_taxonomy(evidence: DataFrame, id_column: str) -> DataFrame:
    """Per id the primary section, all sections and scored candidates, from rows of (id, kind, section): scores add up to at most 1.

    "others" counts only where an override says so; the primary section is then the first candidate whose score reaches its
    limit, if there is one. An id without any candidate is "others".
    """
    table = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    rows = evidence.select(id_column, "section", "kind", F.element_at(table(WEIGHTS), F.col("kind")).alias("weight"))
    says = F.col("section").isin(*SECTIONS) & F.col("weight").isNotNull() & ((F.col("section") != "others") | (F.col("kind") == "override"))
    scored = rows.withColumn("says", F.coalesce(says, F.lit(False))).groupBy(id_column, "section", "says").agg(F.least(F.round(F.sum("weight"), 2), F.lit(1.0)).alias("score"), F.array_sort(F.collect_set("kind")).alias("reasons"))
    one = F.struct((-F.col("score")).alias("order"), section_rank(F.col("section")).alias("rank"), "section", "score", "reasons")
    none = F.array(F.struct(F.lit(-1.0).alias("order"), section_rank(F.lit("others")).alias("rank"), F.lit("others").alias("section"), F.lit(1.0).alias("score"), F.array(F.lit("fallback:others")).alias("reasons")))
    out = scored.groupBy(id_column).agg(F.array_sort(F.collect_list(F.when(F.col("says"), one))).alias("x")).withColumn("x", F.when(F.size("x") > 0, F.col("x")).otherwise(none))
    enough = F.filter("x", lambda c: (c.section != "others") & (c.score >= F.coalesce(F.element_at(table(RECOVERED_FROM), c.section), F.lit(2.0))))
    first = F.col("x")[0].section
    primary = F.when(first == "others", F.coalesce(F.get(enough, 0).section, F.lit("others"))).otherwise(first)
    listed = F.transform("x", lambda c: F.struct(c.section.alias("label"), c.score.alias("score"), c.reasons.alias("reasons")))
    return out.select(id_column, primary.alias("primary_section"), F.transform("x", lambda c: c.section).alias("sections"), listed.alias("section_candidates"))


def detect_topics(rows: DataFrame, id_column: str, section: str, folded: Column, rules: DataFrame) -> DataFrame:
    """(id, topics, primary_topic) of rows with a topic: best first, then by label.

    ``rules`` (section, label, priority, pattern) are patterns on folded text. Of the rules of a row's section a label that
    matches scores 0.6, and 0.15 more for each further pattern of it, at most 1.
    """
    base = rows.select(F.col(id_column).alias("id"), F.col(section).alias("section"), folded.alias("text"))
    found = pattern_matches(base.select("id", "section", "text"), F.col("text"), rules, ["section"])
    hits = found.groupBy("id", "label").agg(F.count_distinct("priority", "pattern").alias("n")).withColumn("score", F.least(F.round(0.6 + 0.15 * (F.col("n") - 1), 2), F.lit(1.0)))
    listed = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "label", "score"))).alias("x"))
    return listed.select(F.col("id").alias(id_column), F.transform("x", lambda t: F.struct(t.label.alias("label"), t.score.alias("score"))).alias("topics"), F.col("x")[0].label.alias("primary_topic"))


def infer_geo(rows: DataFrame, id_column: str, folded: Column, places: DataFrame, aliases: DataFrame, countries: DataFrame, fallback: str, source_hints: DataFrame | None = None) -> DataFrame:
    """``rows`` with geo_country, location, lat, lon and decided_by: a place in the text, else a country's name in it, else what source and link hint at, else the fallback.

    Keywords may have several words. ``places`` has priority, keyword, name, country, lat, lon; ``aliases`` priority,
    keyword, country; ``countries`` country, lat, lon; ``source_hints`` source_part, segment, country, for rows with source
    and url: the link's first two segments are looked up, and a hint without a country stands for none at all.
    """
    hubs = places.select("priority", "keyword", F.col("country").alias("hub_country"), F.col("name").alias("hub"), F.col("lat").alias("hub_lat"), F.col("lon").alias("hub_lon"))
    out = first_rule(rows, id_column, folded, hubs, "hub_country", "hub", "hub_lat", "hub_lon")
    out = first_rule(out, id_column, folded, aliases.withColumnRenamed("country", "alias_country"), "alias_country")
    if source_hints is None:
        out = out.withColumns({"hint_country": F.lit(None).cast("string"), "hinted": F.lit(False)})
    else:
        segments = F.slice(F.filter(F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), "/"), lambda x: x != ""), 1, 2)
        by_segment = small(source_hints.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("source_part", F.col("country").alias("hint_country")))).alias("hints")))
        for k in (0, 1):
            out = out.withColumn("segment", F.get(segments, F.lit(k))).join(by_segment.withColumnRenamed("hints", f"__hints_{k}"), "segment", "left").drop("segment")
        met = lambda k: F.get(F.filter(f"__hints_{k}", lambda h: F.contains(F.lower("source"), h.source_part)), 0)
        out = out.withColumn("__hint", F.coalesce(met(1), met(0))).withColumns({"hint_country": F.col("__hint.hint_country"), "hinted": F.col("__hint").isNotNull()})
    by = F.when(F.col("hub").isNotNull(), "place").when(F.col("alias_country").isNotNull(), "country").when(F.col("hinted"), "hint").when(F.col(fallback).isNotNull(), "fallback").otherwise("none")
    country = F.when(F.col("hub").isNotNull(), F.col("hub_country")).when(F.col("alias_country").isNotNull(), F.col("alias_country")).when(F.col("hinted"), F.col("hint_country")).otherwise(F.col(fallback))
    out = out.withColumns({"geo_country": country, "decided_by": by})
    # a country stands at its own place, else at its first hub
    own = countries.select(F.col("country").alias("geo_country"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    hubs = places.groupBy(F.col("country").alias("geo_country")).agg(F.min_by(F.struct(F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon")), "priority").alias("h")).select("geo_country", "h.*")
    out = out.join(small(own), "geo_country", "left").join(small(hubs), "geo_country", "left")
    return out.select(*(F.col(c) for c in rows.columns), "geo_country", F.coalesce("hub", "geo_country").alias("location"), F.coalesce("hub_lat", "c_lat", "h_lat").alias("lat"), F.coalesce("hub_lon", "c_lon", "h_lon").alias("lon"), "decided_by")


def resolve_publisher(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Per (source, country) the publisher of the first rule that fits: kind exact, prefix or contains, countries or null for all.

    Sources are made distinct first, so that the rules meet names, not articles. Exact names meet rules by equality, their
    beginnings of as many characters as some rule has likewise, and parts of names are found by the automaton of ``matcher``.
    """
    names = rows.select("source", "country").distinct().withColumn("name", F.lower(F.trim("source")))
    of = lambda kind: rules.where(F.col("kind") == kind)
    lengths = [r.n for r in of("prefix").select(F.length("pattern").alias("n")).distinct().collect()]  # of patterns, a handful
    starts = F.array(*(F.when(F.length("name") >= n, F.substring("name", 1, n)) for n in sorted(lengths))).cast("array<string>")
    inner = [r.pattern for r in of("contains").select("pattern").distinct().limit(MOST_RULES + 1).collect()]
    if len(inner) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules of kind contains")
    keyed = [("exact", names.withColumn("pattern", F.col("name"))), ("prefix", names.withColumn("pattern", F.explode(starts))), ("contains", names.withColumn("pattern", F.explode(finder(inner)("name"))))]
    met = [keys.join(small(of(kind)), "pattern").where(F.col("countries").isNull() | F.array_contains("countries", F.col("country"))).select("source", "country", "rule_no", "publisher", "kind") for kind, keys in keyed]
    best = met[0].unionByName(met[1]).unionByName(met[2]).groupBy("source", "country").agg(F.min_by(F.struct("publisher", "kind"), "rule_no").alias("x"))
    out = names.join(best, ["source", "country"], "left")
    confidence = F.when(F.col("x.kind") == "exact", "high").when(F.col("x.kind") == "prefix", "medium").otherwise("low")
    return out.select("source", "country", F.coalesce("x.publisher", F.trim("source")).alias("publisher"), confidence.alias("confidence"), F.coalesce("x.kind", F.lit("display_name")).alias("matched_by"))


def endpoint_profile(feeds: DataFrame) -> DataFrame:
    """``feeds`` with sitemap_kind and profile."""
    text = F.lower(F.coalesce("sitemap_url", F.lit("")))
    kind = F.when(text == "", None).when(text.rlike("index"), "index").when(text.rlike("news"), "news").otherwise("other")
    rss, portal = F.col("rss_url").isNotNull(), F.col("distribution_class") == "portal"
    profile = F.when(~F.col("enabled"), "disabled").when(portal, "portal").when(rss & kind.isNotNull(), "rss_and_sitemap").when(rss, "rss_only").when(kind == "news", "news_sitemap_only").when(kind.isNotNull(), "sitemap_only").otherwise("none")
    return feeds.withColumns({"sitemap_kind": kind, "profile": profile})


def foreign_operated(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Sources that a group of another country runs in a market: first rule of (rule_no, market, pattern, corporate_country)."""
    found = rows.select("source", "country").distinct().join(small(rules), (F.col("country") == F.col("market")) & F.contains(F.lower("source"), F.col("pattern")))
    return found.groupBy("source", "country").agg(F.min_by("corporate_country", "rule_no").alias("corporate_country")).where(F.col("corporate_country") != F.col("country"))


def signatures(url: Column, depth: int = 3) -> Column:
    """host, host/first segment, ... up to ``depth`` segments, each with its depth."""
    path = F.slice(F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != ""), 1, depth)
    each = lambda x: F.transform(F.sequence(F.lit(0), F.size(x["path"])), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", x["host"], F.array_join(F.slice(x["path"], 1, n), "/")).alias("signature")))
    return let(F.struct(host_of(url).alias("host"), path.alias("path")), each)


def _commonest(counts: DataFrame, *key: str) -> DataFrame:
    """Per key the category of most articles, of equals the last by name, their number n, and samples, the articles of all categories."""
    per = counts.groupBy(*key).agg(F.sum("n").alias("samples"), F.max(F.struct("n", "category")).alias("x"))
    return per.select(*key, F.col("x.category").alias("category"), "samples", F.col("x.n").alias("n"))


def learn_signature_categories(filled: DataFrame, min_support: int = 8, min_share: float = 0.6) -> DataFrame:
    """Per (source, signature) the category that most of its articles have, where enough have it. ``filled`` has source, url, category."""
    rows = filled.select("source", "category", F.explode(signatures(F.col("url"))).alias("s")).select("source", "category", "s.*")
    counts = rows.groupBy("source", "depth", "signature", "category").agg(F.count("*").alias("n"))
    return _commonest(counts, "source", "depth", "signature").where((F.col("samples") >= min_support) & (F.col("n") >= min_share * F.col("samples")))


def predict_signature_categories(empty: DataFrame, learned: DataFrame, id_column: str) -> DataFrame:
    """For articles without a category that of their deepest learned signature."""
    rows = empty.select(id_column, "source", F.explode(signatures(F.col("url"))).alias("s")).select(id_column, "source", "s.*")
    found = rows.join(learned, ["source", "depth", "signature"])
    return found.groupBy(id_column).agg(F.max(F.struct("depth", "category")).alias("x")).select(id_column, "x.category", "x.depth")


def learn_token_categories(filled: DataFrame, min_support: int = 5, min_share: float = 0.5) -> DataFrame:
    """Per (source, word of the link) the category that at least half of its articles have."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), "[^a-z]+"), lambda w: F.length(w) >= 3))
    rows = filled.select("source", "category", F.explode(words).alias("token"))
    counts = rows.groupBy("source", "token", "category").agg(F.count("*").alias("n"))
    return _commonest(counts, "source", "token").where((F.col("samples") >= min_support) & (F.col("n") >= min_share * F.col("samples"))).drop("n")


def predict_token_categories(empty: DataFrame, learned: DataFrame, id_column: str, min_score: int = 2) -> DataFrame:
    """Votes of an article's words; a category needs ``min_score`` of them."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), "[^a-z]+"), lambda w: F.length(w) >= 3))
    votes = empty.select(id_column, "source", F.explode(words).alias("token")).join(learned, ["source", "token"]).groupBy(id_column, "category").agg(F.count("*").alias("score"))
    return votes.where(F.col("score") >= min_score).groupBy(id_column).agg(F.max(F.struct("score", "category")).alias("x")).select(id_column, "x.category", "x.score")


def path_segment_categories(articles: DataFrame, exact: dict[str, str], parts: tuple, min_support: int = 20) -> DataFrame:
    """Per source the path segments that name a section and are frequent enough."""
    segments = F.array_distinct(F.filter(F.split(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^?#]*)/[^/]*$", 1)), "/"), lambda s: s != ""))
    rows = articles.select("source", F.explode(segments).alias("segment")).withColumn("section", map_category(F.col("segment"), exact, parts)).where("section is not null")
    return rows.groupBy("source", "segment", "section").agg(F.count("*").alias("n")).where(F.col("n") >= min_support)


def lexical_categories(url: Column, source: Column, known: tuple[str, ...], patterns: tuple[tuple[str, str], ...] = (), topics: Column | None = None) -> Column:
    """Path segments of a fixed set, categories whose pattern a source's name matches, its label parts in brackets or after `` - ``; a row that has none of these takes its topics."""
    path = F.filter(F.split(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), "/"), lambda s: s != "")
    label = F.filter(F.array(F.regexp_extract(source, r"[\[(]([^\])]+)[\])]", 1), F.regexp_extract(source, r" - ([^-]+)$", 1)), lambda s: s != "")
    named = F.filter(F.array(*(F.when(source.rlike(pattern), F.lit(category)) for pattern, category in patterns)).cast("array<string>"), lambda c: c.isNotNull())
    found = F.array_distinct(F.concat(F.array_intersect(path, F.array(*(F.lit(k) for k in known))), named, F.transform(label, lambda s: F.lower(F.trim(s)))))
    if topics is None:
        return found
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array_distinct(F.filter(F.transform(topics, lambda t: F.lower(F.trim(t))), lambda t: t.isNotNull() & (t != "")))))


def to_reclassify(articles: DataFrame, as_of: datetime, days: int, force: bool = False, created_hours: int | None = None, section: str | None = None, sources: tuple[str, ...] = (), categories: tuple[str, ...] = ()) -> DataFrame:
    """Articles of so many days that were never derived or are incomplete (all, if forced), of a section, of some sources, with some category."""
    rows = articles.where(since("publication_datetime", as_of, days=days))
    if not force:
        lacks = present("primary_section").isNull() | (F.size("feed_categories") <= 0)
        rows = rows.where(lacks | F.col("taxonomy_derived_at").isNull() if "taxonomy_derived_at" in articles.columns else lacks)
    if created_hours is not None:
        rows = rows.where(since("created_at", as_of, hours=created_hours))
    if section is not None:
        rows = rows.where(F.coalesce(present("primary_section"), F.lit("others")) == section)
    if sources:
        rows = rows.where(F.col("source").isin(*sources))
    if categories:
        rows = rows.where(F.arrays_overlap("feed_categories", F.array(*(F.lit(c) for c in categories))))
    return rows


def reclassified(rows: DataFrame, exact: dict[str, str], parts: tuple, keywords: DataFrame, topics: DataFrame, key: str = "external_id") -> DataFrame:
    """(key, primary_section, sections, primary_topic, topics) of articles, derived anew (C5, then C6) from their stored section, categories and title."""
    one = rows.groupBy(key).agg(F.min_by(F.struct("primary_section", "feed_categories", "title_original"), F.struct("title_original", "url")).alias("x")).select(key, "x.*")
    title = classify_keyword(one, key, fold_text("title_original"), keywords).select(key, F.lit("title").alias("kind"), "section")
    stored = one.select(key, F.lit("stored").alias("kind"), F.col("primary_section").alias("section"))
    named = one.select(key, F.lit("feed_category").alias("kind"), F.explode(F.array_distinct(F.transform("feed_categories", lambda c: map_category(c, exact, parts)))).alias("section"))
    taxonomy = build_taxonomy(stored.unionByName(title).unionByName(named), key).select(key, "primary_section", "sections")
    found = detect_topics(taxonomy.join(one.select(key, "title_original"), key), key, "primary_section", fold_text("title_original"), topics)
    return taxonomy.join(found, key, "left")


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")
