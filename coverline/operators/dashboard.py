"""Dashboard and audits of sections, topics and categories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import at, low_signal_title, percent, present, ratio, section_rank, since
from coverline.operators.benchmark import clamped_publication

EMPTY = "(empty)"


def section_of() -> F.Column:
    return F.coalesce(present("primary_section"), F.lit("others"))


def dashboard_totals(articles: DataFrame, as_of: datetime, days: int = 31, hours: int = 24) -> DataFrame:
    recent = articles.where(since("created_at", as_of, days=days))
    return recent.agg(F.count("*").alias("n_articles"), F.count_if(since("created_at", as_of, hours=hours)).alias("inserted"), F.count_if(since("publication_datetime", as_of, hours=hours)).alias("published")).withColumn("generated_at", at(as_of))


def dashboard_sections(articles: DataFrame, as_of: datetime, days: int = 31) -> DataFrame:
    return articles.where(since("created_at", as_of, days=days)).groupBy(section_of().alias("section")).agg(F.count("*").alias("n_articles"))


def dashboard_topics(articles: DataFrame, as_of: datetime, days: int = 31, limit: int = 3) -> DataFrame:
    """Per section: articles, those without a topic, and the top topics (count, then name)."""
    rows = articles.where(since("created_at", as_of, days=days)).select(section_of().alias("section"), present("primary_topic").alias("topic"))
    counts = rows.groupBy("section", "topic").agg(F.count("*").alias("n"))
    ranked = counts.where("topic is not null").withColumn("__rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "topic"))).where(F.col("__rank") <= limit)
    top = ranked.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "topic", "n"))), lambda x: F.concat_ws(":", x.topic, x.n.cast("string"))), "|").alias("top_topics"))
    totals = counts.groupBy("section").agg(F.sum("n").alias("n_articles"), F.sum(F.when(F.col("topic").isNull(), F.col("n")).otherwise(0)).alias("unassigned"))
    return totals.join(top, "section", "left").withColumn("section_rank", section_rank(F.col("section")))


def category_coverage(articles: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """Totals of categorised articles, and the most frequent categories."""
    filled = F.size("feed_categories") > 0
    totals = articles.agg(F.count_if(filled).alias("categorised"), F.count_if(~F.coalesce(filled, F.lit(False))).alias("uncategorised"))
    rows = articles.select(F.explode("feed_categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    totals = totals.withColumn("n_categories", rows.agg(F.count("*")).scalar())
    return totals, rows.orderBy(F.desc("n"), "category").limit(limit)


def recent_dates(articles: DataFrame, as_of: datetime, limit: int = 7) -> DataFrame:
    """The last dates with counts, and which of them a preview shows: the newest before today, else the newest."""
    day = F.to_date("publication_datetime")
    dates = articles.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(limit)
    today = F.lit(as_of.date().isoformat()).cast("date")
    shown = dates.agg(F.coalesce(F.max(F.when(F.col("day") < today, F.col("day"))), F.max("day")))
    return dates.select("day", "n", (F.col("day") == shown.scalar()).alias("preview"))


def preview(articles: DataFrame, feeds: DataFrame, as_of: datetime, hours: int = 24, top: int = 10) -> DataFrame:
    """Countries with most articles of direct publishers."""
    portals = feeds.where("distribution_class = 'portal'").select("source").distinct()
    direct = articles.where(since("publication_datetime", as_of, hours=hours)).join(portals, "source", "left_anti")
    return direct.groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(top)


def preview_headlines(articles: DataFrame, feeds: DataFrame, as_of: datetime, top: int = 20) -> DataFrame:
    """Newest headlines that can be read."""
    portals = feeds.where("distribution_class = 'portal'").select("source").distinct()
    fine = articles.where((F.col("publication_datetime") < at(as_of)) & ~low_signal_title(F.col("title_original"), F.col("url"), F.col("source"), F.col("title_quality")))
    return fine.join(portals, "source", "left_anti").orderBy(F.desc("publication_datetime"), F.desc("created_at"), "external_id").limit(top).select("external_id", "source", "title_original", "publication_datetime")


def country_report(articles: DataFrame, feeds: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Per registry country, by the outlet's country and by the article's: direct and portal publications, inserted, fresh, late."""
    kinds = feeds.groupBy("source").agg(F.max(F.when(F.col("distribution_class") == "portal", 1).otherwise(0)).alias("portal"))
    pub, made = since("publication_datetime", as_of, hours=hours), since("created_at", as_of, hours=hours)
    rows = articles.where((pub | made) & (F.coalesce(present("title_quality"), F.lit("ok")) != "suspect")).join(kinds, "source", "left").withColumn("portal", F.coalesce("portal", F.lit(0)))
    views = F.explode(F.array(F.struct(F.lit("publisher").alias("view"), present("source_country").alias("place")), F.struct(F.lit("coverage").alias("view"), present("country").alias("place"))))
    spread = rows.select("publication_datetime", "created_at", "portal", views.alias("x")).select("publication_datetime", "created_at", "portal", "x.*").where("place is not null")
    counts = spread.groupBy("view", F.col("place").alias("country")).agg(
        F.count_if(pub & (F.col("portal") == 0)).alias("core_published"), F.count_if(pub & (F.col("portal") == 1)).alias("portal_published"), F.count_if(pub).alias("published"),
        F.count_if(since("created_at", as_of, hours=1)).alias("inserted_1h"), F.count_if(made).alias("inserted"), F.count_if(made & pub).alias("fresh"), F.count_if(made & ~pub).alias("late"),
    )
    wanted = feeds.select("country").distinct().select("country", F.explode(F.array(F.lit("publisher"), F.lit("coverage"))).alias("view"))
    out = wanted.join(counts, ["country", "view"], "left")
    values = [c for c in counts.columns if c not in ("view", "country")]
    return out.select("country", "view", *(F.coalesce(c, F.lit(0)).alias(c) for c in values)).withColumn("late_share", percent(F.col("late"), F.col("inserted")))


def recent_counts(articles: DataFrame, as_of: datetime, hours: int = 24, limit: int = 50) -> DataFrame:
    rows = articles.where(since("created_at", as_of, hours=hours)).groupBy("source", "source_country").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "source", F.asc_nulls_last("source_country")).limit(limit)


def recent_country_counts(articles: DataFrame, as_of: datetime) -> DataFrame:
    return articles.groupBy("country").agg(F.count_if(since("created_at", as_of, hours=1)).alias("n_1h"), F.count_if(since("created_at", as_of, hours=24)).alias("n_24h"))


def configured_coverage(feeds: DataFrame) -> DataFrame:
    """Per country and in all (country null): registrations, enabled ones, sources and typed endpoints."""
    ends = feeds.select("country", "source", "enabled", "distribution_class", F.explode(F.array(F.struct(F.lit("rss").alias("type"), F.col("rss_url").alias("url")), F.struct(F.lit("sitemap").alias("type"), F.col("sitemap_url").alias("url")))).alias("e"))
    ends = ends.select("country", "source", "enabled", "distribution_class", "e.*").where("url is not null")
    return ends.rollup("country").agg(
        F.count("*").alias("registrations"), F.count_if("enabled").alias("active"), F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("distribution_class") != "portal", F.col("source"))).alias("direct_sources"),
        F.countDistinct(F.when(F.col("type") == "rss", F.col("url"))).alias("rss_endpoints"), F.countDistinct(F.when(F.col("type") == "sitemap", F.col("url"))).alias("sitemap_endpoints"),
    )


def taxonomy_audit(articles: DataFrame, as_of: datetime, hours: int = 168, least_country: int = 50, least_source: int = 20, least_recoverable: int = 10, top: int = 15) -> DataFrame:
    """How much falls into "others": in all, and the first ``top`` of three lists, in rows by ``list`` and rank.

    ``countries`` go by articles in others, ``missing_signal`` sources by those that have no categories either, ``recoverable`` sources by
    those that have some; each list has its own least number of articles (for the last of articles with categories), and goes on by
    share, articles and name.
    """
    others, empty = section_of() == "others", F.coalesce(F.size("feed_categories") <= 0, F.lit(True))
    rows = articles.where(since("created_at", as_of, hours=hours)).select("country", "source", others.alias("others"), empty.alias("empty"))
    found = rows.groupingSets([[], [F.col("country")], [F.col("country"), F.col("source")]], F.col("country"), F.col("source")).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if("others").alias("n_others"), F.count_if("empty").alias("n_empty"), F.count_if(F.col("others") & F.col("empty")).alias("n_both"), F.count_if(F.col("others") & ~F.col("empty")).alias("n_recoverable"),
    )
    filled = F.col("n") - F.col("n_empty")
    shares = {"others_pct": percent(F.col("n_others"), F.col("n")), "empty_pct": percent(F.col("n_empty"), F.col("n")), "both_pct": percent(F.col("n_both"), F.col("n")), "recoverable_pct": percent(F.col("n_recoverable"), filled)}
    found = found.withColumns(shares).withColumn("filled", filled)
    names = [F.coalesce("country", F.lit("")), F.coalesce("source", F.lit(""))]

    def listed(name: str, level: int, size: str, least: int, by: str) -> DataFrame:
        order = Window.orderBy(F.desc(f"n_{by}"), F.desc(f"{by}_pct"), F.desc("n"), *names)  # rows are countries or sources
        ranked = found.where((F.col("level") == level) & (F.col(size) >= least)).orderBy(F.desc(f"n_{by}"), F.desc(f"{by}_pct"), F.desc("n"), *names).limit(top)
        return ranked.withColumns({"rank": F.row_number().over(order).cast("long"), "list": F.lit(name)})

    total = found.where("level = 3").withColumns({"rank": F.lit(1).cast("long"), "list": F.lit("total")})
    lists = total.unionByName(listed("countries", 1, "n", least_country, "others")).unionByName(listed("missing_signal", 0, "n", least_source, "both")).unionByName(listed("recoverable", 0, "filled", least_recoverable, "recoverable"))
    return lists.select("list", "rank", "country", "source", "n", "n_others", "n_empty", "n_both", "n_recoverable", *shares)


def unmapped_categories(articles: DataFrame, samples: int = 3) -> DataFrame:
    """Categories of "others" articles: articles, sources, and sample sources in order."""
    rows = articles.where(section_of() == "others").select("source", F.explode("feed_categories").alias("category"))
    per = rows.groupBy("category", "source").agg(F.count("*").alias("n"))
    ranked = per.withColumn("__rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "source")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__rank") <= samples, F.struct("__rank", "source")))), lambda x: x.source), ", ")
    return ranked.groupBy("category").agg(F.sum("n").alias("n_articles"), F.count("*").alias("n_sources"), listed.alias("sample_sources"))


def topic_audit(articles: DataFrame, shown: int = 12) -> DataFrame:
    """Per section its topics, and of its articles without one the categories and sources: the first ``shown`` of each list with their share of the section, then what the rest hides.

    The row of the rest is named ``(hidden)``; ``n_names`` says how many names it stands for.
    """
    rows = articles.select(section_of().alias("section"), present("primary_topic").alias("topic"), "feed_categories", present("source").alias("source"))
    none = rows.where("topic is null")
    count = lambda rows, name, kind: rows.groupBy("section", name.alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    lists = count(rows, F.coalesce("topic", F.lit(EMPTY)), "topic").unionByName(count(none.select("section", F.explode_outer("feed_categories").alias("c")), F.coalesce(present("c"), F.lit(EMPTY)), "unassigned_category")).unionByName(count(none, F.coalesce("source", F.lit("(unknown source)")), "unassigned_source"))
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("section", "kind").orderBy(F.desc("n"), "name")))
    tail = F.col("rank") > shown
    per = ranked.groupBy("section", "kind", F.when(tail, shown + 1).otherwise(F.col("rank")).alias("rank"), F.when(tail, "(hidden)").otherwise(F.col("name")).alias("name")).agg(F.sum("n").alias("n"), F.count("*").alias("n_names"))
    totals = rows.groupBy("section").agg(F.count("*").alias("total"))
    return per.join(totals, "section").select("section", "kind", "rank", "name", "n", "n_names", percent(F.col("n"), F.col("total")).alias("pct"))


def others_audit(articles: DataFrame, candidates: str = "section_candidates", samples: int = 2, top: int = 3) -> DataFrame:
    """Best other candidate of each "others" article: articles, mean score in hundredths, sources, top sources and categories, sample titles per candidate."""
    best = F.array_max(F.transform(F.filter(candidates, lambda x: x.label != "others"), lambda x: F.struct(x.score.alias("score"), x.label.alias("label"))))
    rows = articles.where(section_of() == "others").select("source", "title_original", "external_id", "feed_categories", best.alias("best")).where("best is not null").select("source", "title_original", "external_id", "feed_categories", "best.*")

    def tops(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("label", name).agg(F.count("*").alias("n"))
        ranked = per.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), name))).where(F.col("k") <= top)
        return ranked.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", name, "n"))), lambda x: F.concat_ws(":", x[name], x.n.cast("string"))), "|").alias(f"top_{name}"))

    # each task passes on its own best rows only, however many a candidate has
    first = rows.select("label", "score", "external_id", "title_original").withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "external_id", "title_original"))).where(F.col("k") <= samples)
    titles = first.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "title_original"))), lambda x: x.title_original), "|").alias("sample_titles"))
    per = rows.groupBy("label").agg(F.count("*").alias("n_articles"), F.floor(F.avg("score") * 100 + 0.5).cast("long").alias("mean_score"), F.countDistinct("source").alias("n_sources")).join(titles, "label")
    categories = tops(rows.select("label", F.explode("feed_categories").alias("categories")), "categories")
    return per.join(tops(rows.withColumnRenamed("source", "sources"), "sources"), "label", "left").join(categories, "label", "left").withColumnRenamed("label", "candidate")


def mention_lanes(articles: DataFrame, mentions: DataFrame, top_teams: int = 25) -> DataFrame:
    """Of a lane of official articles (external_id, team) and what they mention (article_external_id, entity_type), rows by ``part``.

    ``totals`` counts articles, those with a mention, and these in percent; ``type`` each entity type's mentions and articles; ``team``
    the first teams by articles, with those that mention anything and a team; ``gap`` the articles that name a person or
    competition but no team, by the types that they do name.
    """
    official = articles.groupBy(F.col("external_id").alias("article_external_id")).agg(F.min("team").alias("team"))
    known = mentions.join(official.select("article_external_id"), "article_external_id", "left_semi")
    flags = known.groupBy("article_external_id").agg(F.bool_or(F.col("entity_type") == "team").alias("has_team"), F.bool_or(F.col("entity_type").isin("person", "competition")).alias("has_other"), F.array_join(F.array_sort(F.collect_set("entity_type")), "+").alias("types"))
    marked = official.join(flags, "article_external_id", "left")
    linked, named = F.count("has_team"), F.count_if("has_team")
    part = lambda rows, kind, name, n, a, b: rows.select(F.lit(kind).alias("part"), F.col(name).cast("string").alias("name"), *(F.col(c).cast("long").alias(x) for c, x in ((n, "n_articles"), (a, "n_linked"), (b, "n_mentions"))))
    totals = marked.agg(F.lit(None).cast("string").alias("name"), F.count("*").alias("n"), linked.alias("a"), percent(linked, F.count("*")).alias("b"))
    types = known.groupBy("entity_type").agg(F.count("*").alias("b"), F.countDistinct("article_external_id").alias("n"), F.countDistinct("article_external_id").alias("a"))
    teams = marked.groupBy("team").agg(F.count("*").alias("n"), linked.alias("a"), named.alias("b")).orderBy(F.desc("n"), "team").limit(top_teams)
    gaps = marked.where("has_other and not has_team").groupBy("types").agg(F.count("*").alias("n"), F.count("*").alias("a"), F.lit(0).alias("b"))
    return part(totals, "totals", "name", "n", "a", "b").unionByName(part(types, "type", "entity_type", "n", "a", "b")).unionByName(part(teams, "team", "team", "n", "a", "b")).unionByName(part(gaps, "gap", "types", "n", "a", "b"))


def tool_usage(*families: DataFrame) -> DataFrame:
    """Per day, tool and traffic of all families of tools together: calls, errors, time with its mean, and four latency buckets.

    Every family has day, tool, traffic, outcome and duration_ms; a tool that two have is one.
    """
    columns = ("day", "tool", "traffic", "outcome", "duration_ms")
    calls = families[0].select(*columns)
    for more in families[1:]:
        calls = calls.unionByName(more.select(*columns))
    ms = F.col("duration_ms")
    return calls.groupBy("day", "tool", "traffic").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "success").alias("successes"), F.count_if(F.col("outcome") == "error").alias("errors"), F.sum(ms).alias("sum_ms"), F.max(ms).alias("max_ms"),
        F.count_if(ms < 100).alias("under_100"), F.count_if((ms >= 100) & (ms < 500)).alias("under_500"), F.count_if((ms >= 500) & (ms < 2000)).alias("under_2000"), F.count_if(ms >= 2000).alias("from_2000"),
        percent(F.count_if(F.col("outcome") == "error"), F.count("*")).alias("error_pct"), ratio(F.sum(ms), F.count(ms), 1).alias("mean_ms"),
    )


def latest_per_source(articles: DataFrame, limit: int = 40) -> DataFrame:
    """Newest article of each source, newest first."""
    newest = articles.groupBy("source").agg(F.max_by(F.struct("external_id", "url", "publication_datetime"), F.struct("publication_datetime", "created_at", "external_id")).alias("x")).select("source", "x.*")
    return newest.orderBy(F.desc("publication_datetime"), "source").limit(limit)


def fix_backlog(failures: DataFrame, outlets: int = 20) -> DataFrame:
    """Failures by (domain, reason): rows, countries, first outlets, and the commonest action."""
    per = failures.groupBy("domain", "reason", "action").agg(F.count("*").alias("n"), F.collect_set("country").alias("countries"), F.collect_set("outlet").alias("outlets"))
    return per.groupBy("domain", "reason").agg(
        F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("countries")))).cast("long").alias("n_countries"),
        F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("outlets")))), 1, outlets), ",").alias("outlets"), F.max_by("action", F.struct("n", "action")).alias("action"),
    )


def published_per_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("n"), F.max(clamped_publication()).alias("last"))
