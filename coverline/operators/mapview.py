"""Map of coverage: metrics of sources, countries and publishers over 1 hour, 24 hours and 7 days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import at, percent, present, since
from coverline.functions.titles import display_source
from coverline.operators.classify import endpoint_profile

WINDOWS = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7)}
METRICS = ("pub", "fresh", "late", "first_seen")


def map_source_metrics(articles: DataFrame, as_of: datetime, window: str = "7d") -> DataFrame:
    """Per (source_country, article_country, source) all counts at once; windows longer than the chosen one are 0.

    The publication time is not clamped here, on purpose: the map shows what outlets state.
    """
    ago = lambda column, name: F.col(column) >= at(as_of - WINDOWS[name])
    chosen = list(WINDOWS)[: list(WINDOWS).index(window) + 1]

    def count(metric: str, name: str) -> Column:
        if name not in chosen:
            return F.lit(0).cast("long")
        pub, made = ago("publication_datetime", name), ago("created_at", name)
        return F.count_if({"pub": pub, "fresh": pub & made, "late": made & ~pub, "first_seen": made}[metric])

    rows = articles.where((ago("publication_datetime", window) | ago("created_at", window)) & (F.coalesce(present("title_quality"), F.lit("ok")) != "suspect"))
    keyed = rows.select(present("source_country").alias("source_country"), present("country").alias("article_country"), "source", "publication_datetime", "created_at")
    out = keyed.groupBy("source_country", "article_country", "source").agg(*(count(m, w).alias(f"{m}_{w}") for w in WINDOWS for m in METRICS))
    out = out.withColumn("country", F.coalesce("source_country", "article_country"))
    return out if window == "7d" else out.where((F.col(f"pub_{window}") > 0) | (F.col(f"first_seen_{window}") > 0))


def endpoint_breakdown(feeds: DataFrame) -> DataFrame:
    """Per country: direct sources configured, and how many have a feed, a sitemap or both."""
    runnable = feeds.where(F.col("enabled") & (F.col("distribution_class") != "portal") & (F.col("rss_url").isNotNull() | F.col("sitemap_url").isNotNull()))
    rss, site = F.col("rss_url").isNotNull(), F.col("sitemap_url").isNotNull()
    return runnable.groupBy("country").agg(
        F.countDistinct("source").alias("configured_sources"), F.count_if(rss & ~site).alias("rss_only"), F.count_if(site & ~rss).alias("sitemap_only"), F.count_if(rss & site).alias("rss_and_sitemap"),
    )


TOTAL = "(total)"


def source_methods(feeds: DataFrame) -> DataFrame:
    """(country, source, method, profile) of enabled registrations: which endpoints a source has, and its profile; of several profiles the first by name."""
    rows = endpoint_profile(feeds).where("enabled")
    per = rows.groupBy("country", display_source(F.col("source")).alias("source")).agg(F.max(F.col("rss_url").isNotNull()).alias("rss"), F.max(F.col("sitemap_url").isNotNull()).alias("site"), F.min("profile").alias("profile"))
    return per.select("country", "source", F.when(F.col("rss") & F.col("site"), "rss+sitemap").when(F.col("rss"), "rss").when(F.col("site"), "sitemap").alias("method"), "profile")


def _top_names(rows: DataFrame, name: str, value: str, top: int) -> DataFrame:
    """Per country the first ``top`` names by a sum that is not 0, joined by bars; rows are sums by name already."""
    per = rows.where(F.col(name).isNotNull()).groupBy("country", name).agg(F.sum(value).alias("__n")).where("__n > 0")
    ranked = per.withColumn("__rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("__n"), name))).where(F.col("__rank") <= top)
    return ranked.groupBy("country").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rank", name))), lambda x: x[name]), "|").alias(f"top_{name}s"))


def map_country_metrics(metrics: DataFrame, health: DataFrame, feeds: DataFrame, checked: DataFrame, publishers: DataFrame, window: str = "24h", top: int = 3) -> DataFrame:
    """Per country, and in a row of totals: sums over its sources, active sources and how many of them have a feed or a sitemap, healthy sources, late share, configured and checked counts; per country the top sources and publishers.

    ``metrics`` comes from ``map_source_metrics``, ``health`` has source and health, ``checked`` country and source, ``publishers`` source and
    publisher; a source without one is its own. Totals add up the countries.
    """
    values = [f"{m}_{w}" for w in WINDOWS for m in METRICS]
    per = metrics.where("country is not null").groupBy("country", display_source(F.col("source")).alias("source")).agg(*(F.sum(v).alias(v) for v in values))
    states = health.groupBy("source").agg(F.min("health").alias("health"))
    named = publishers.groupBy("source").agg(F.min("publisher").alias("publisher"))
    active = F.col(f"pub_{window}") > 0
    rows = per.join(states, "source", "left").join(source_methods(feeds).select("country", "source", "method"), ["country", "source"], "left").join(named, "source", "left").withColumn("publisher", F.coalesce("publisher", "source"))
    totals = rows.groupBy("country").agg(
        *(F.sum(v).alias(v) for v in values), F.count_if(active).alias("active_sources"), F.count_if(active & F.coalesce(F.contains("method", F.lit("rss")), F.lit(False))).alias("rss_sources"), F.count_if(active & F.coalesce(F.contains("method", F.lit("sitemap")), F.lit(False))).alias("sitemap_sources"),
        F.count_if(F.col("health") == "healthy").alias("healthy_sources"), F.count_if(F.col("health").isin("degraded", "failing")).alias("degraded_sources"),
    )
    seen = checked.groupBy("country").agg(F.countDistinct("source").alias("checked_sources"))
    out = totals.join(endpoint_breakdown(feeds), "country", "left").join(seen, "country", "left")
    counts = ("active_sources", "rss_sources", "sitemap_sources", "healthy_sources", "degraded_sources", "configured_sources", "rss_only", "sitemap_only", "rss_and_sitemap", "checked_sources")
    out = out.select("country", *values, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    every = out.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*values, *counts))).select(F.lit(TOTAL).alias("country"), *values, *counts)
    out = out.unionByName(every).join(_top_names(rows, "source", f"pub_{window}", top), "country", "left").join(_top_names(rows, "publisher", f"pub_{window}", top), "country", "left")
    return out.withColumns({"late_share": percent(F.col(f"late_{window}"), F.col(f"first_seen_{window}")), "top_sources": F.coalesce("top_sources", F.lit("")), "top_publishers": F.coalesce("top_publishers", F.lit(""))})


def confidence(mean: Column) -> Column:
    """Vote of rules that scored 3, 2 or 1."""
    return F.when(mean >= 2.6, "high").when(mean >= 1.6, "medium").otherwise("low")


def map_publishers(metrics: DataFrame, publishers: DataFrame, window: str = "24h") -> DataFrame:
    """Per publisher: sums, active countries and sources, confidence, and its countries with what each published.

    ``publishers`` has source, publisher and score (3 high, 2 medium, 1 low).
    """
    pub, seen, late = (f"{m}_{window}" for m in ("pub", "first_seen", "late"))
    named = metrics.where("country is not null").join(publishers, "source")
    per = named.groupBy("publisher", "country").agg(F.sum(pub).alias(pub), F.sum(seen).alias(seen), F.sum(late).alias(late), F.countDistinct(F.when(F.col(pub) > 0, F.col("source"))).alias("active"), F.sum("score").alias("score"), F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(pub)).alias("order"), "country"))), lambda x: F.concat_ws(":", x.country, (-x.order).cast("string"))), "|")
    return per.groupBy("publisher").agg(
        F.sum(pub).alias(pub), F.sum(seen).alias(seen), F.sum(late).alias(late), F.count_if(F.col(pub) > 0).alias("active_countries"), F.sum("active").alias("active_sources"),
        confidence(F.sum("score") / F.sum("n")).alias("confidence"), listed.alias("countries"),
    )


#: Where a source is that no place or a foreign group stands for.
UNMAPPED, FOREIGN = "Unmapped / National", "Foreign-operated"


def map_country_sources(metrics: DataFrame, health: DataFrame, feeds: DataFrame, publishers: DataFrame, places: DataFrame, window: str = "24h", top: int = 8) -> DataFrame:
    """Of every country at once the top sources, publishers and regions, in rows of each kind.

    A source comes with its method, profile, health and publisher. ``publishers`` has source and publisher, ``places`` source and region (a
    source without one is unmapped). Regions go by what they published and then their sources, the unmapped last; equal ones by name.
    """
    values = [f"{m}_{window}" for m in METRICS]
    first = lambda rows, c: rows.groupBy("source").agg(F.min(c).alias(c))
    per = metrics.where("country is not null").groupBy("country", "source").agg(*(F.sum(v).alias(v) for v in values))
    facts = per.join(first(health, "health"), "source", "left").join(source_methods(feeds), ["country", "source"], "left").join(first(publishers, "publisher"), "source", "left").join(first(places, "region"), "source", "left")
    rows = facts.withColumns({"health": F.coalesce("health", F.lit("unknown")), "publisher": F.coalesce("publisher", "source"), "region": F.coalesce("region", F.lit(UNMAPPED))})
    detail = ("health", "method", "profile", "publisher")

    def ranked(rows: DataFrame, kind: str, name: str, order: list[Column]) -> DataFrame:
        found = rows.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(*order))).where(F.col("rank") <= top)
        return found.select("country", F.lit(kind).alias("kind"), F.col(name).alias("name"), *values, "n_sources", "rank", *(F.col(c) if kind == "source" else F.lit(None).cast("string").alias(c) for c in detail))

    group = lambda by: rows.groupBy("country", by).agg(*(F.sum(v).alias(v) for v in values), F.count("*").alias("n_sources"))
    sources = ranked(rows.withColumn("n_sources", F.lit(1).cast("long")), "source", "source", [F.desc(values[0]), F.desc(values[3]), F.col("source")])
    owners = ranked(group("publisher"), "publisher", "publisher", [F.desc(values[0]), F.col("publisher")])
    return sources.unionByName(owners).unionByName(ranked(group("region"), "region", "region", [F.col("region").isin(UNMAPPED, FOREIGN), F.desc(values[0]), F.desc("n_sources"), F.col("region")]))


def source_detail(articles: DataFrame, runs: DataFrame, as_of: datetime, runs_as_of: datetime, hours: int = 24) -> DataFrame:
    """Of every source: sums of the last day and its publications by hour, oldest first, and of its checks the failure rate and last error."""
    seen = articles.groupBy("source").agg(F.count_if(since("publication_datetime", as_of, hours=24)).alias("pub_24h"), F.count_if(since("created_at", as_of, hours=24)).alias("first_seen_24h"), F.max("publication_datetime").alias("last_publication"))
    recent = since("ran_at", runs_as_of, hours=24) & F.col("attempted")
    checks = runs.groupBy("source").agg(F.count_if(recent).alias("attempts_24h"), F.count_if(recent & ~F.col("ok")).alias("failures_24h"), F.max_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.struct("ran_at", "id"))).alias("last_error"))
    by_hour = hourly_series(articles, "source", as_of, hours).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("__n"))  # at most ``hours`` + 1 entries a source
    first = (as_of - timedelta(hours=hours)).replace(minute=0, second=0, microsecond=0)
    slots = F.sequence(at(first), at(as_of - timedelta(microseconds=1)), F.expr("INTERVAL '1' HOUR"))
    out = seen.join(checks, "source", "full").join(by_hour, "source", "left")
    series = F.array_join(F.transform(slots, lambda h: F.coalesce(F.try_element_at("__n", h), F.lit(0)).cast("string")), ",")
    return out.select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pub_24h", "first_seen_24h", "attempts_24h", "failures_24h")), "last_publication", "last_error", percent(F.coalesce("failures_24h", F.lit(0)), F.coalesce("attempts_24h", F.lit(0))).alias("failure_pct"), series.alias("hourly"))


def hourly_series(articles: DataFrame, by: str, as_of: datetime, hours: int = 24) -> DataFrame:
    """Publications per key and UTC hour of the last ``hours``."""
    rows = articles.where(since("publication_datetime", as_of, hours=hours) & (F.col("publication_datetime") < at(as_of)) & F.col(by).isNotNull())
    return rows.groupBy(by, F.date_trunc("hour", "publication_datetime").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def daily_series(bench_days: DataFrame, by: str, buckets: int = 7) -> DataFrame:
    """The last day buckets of each key."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("bucket")))
    return bench_days.withColumn("__rank", rank).where(F.col("__rank") <= buckets).select(by, "bucket", "published", "inserted")


def checked_sources(runs: DataFrame, as_of: datetime, hours: int, feeds: DataFrame | None = None, runner: str | None = None) -> DataFrame:
    """Distinct (country, source) that were attempted in the window, by one runner if it is named; with ``feeds`` only those of enabled outlets."""
    out = runs.where(since("ran_at", as_of, hours=hours) & F.col("attempted"))
    out = out if runner is None else out.where(F.col("runner") == runner)
    if feeds is not None:
        out = out.join(feeds.where("enabled").select("outlet_id"), "outlet_id", "left_semi")
    return out.select("country", "source").distinct()
