"""Operations reports over the log of endpoint checks (A28 to A31, A34) and paged tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import at, percent, since


def ops_summary(articles: DataFrame, runs: DataFrame, as_of: datetime, runs_as_of: datetime, top: int = 25) -> DataFrame:
    """Sources by articles and failing checks of the last day; either side may be missing."""
    a = articles.where(since("created_at", as_of, hours=24)).groupBy("source").agg(F.count("*").alias("n_articles"))
    r = runs.where(since("ran_at", runs_as_of, hours=24) & F.col("attempted")).groupBy("source").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    both = a.join(r, "source", "full").select("source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_articles", "attempts", "failures")))
    return both.withColumn("failure_pct", percent(F.col("failures"), F.col("attempts"))).orderBy(F.desc("n_articles"), F.desc("failures"), "source").limit(top)


def ops_rollup(runs: DataFrame, unit: str) -> DataFrame:
    """Additive counters of checks per (bucket, outlet, method)."""
    return runs.where("attempted").groupBy(F.date_trunc(unit, "ran_at").cast("timestamp_ntz").alias("bucket"), "outlet_id", "method").agg(
        F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("fetched_count").alias("fetched"), F.sum("response_ms").alias("response_ms"),
    )


#: Of each mode of the report: the unit its counters are kept in and how many days back it goes.
MODES = {"hourly": ("hour", 1), "daily": ("day", 1), "weekly": ("day", 7)}


def ops_window(rollup: DataFrame, as_of: datetime, mode: str, days: int | None = None) -> DataFrame:
    """The counters that a report of a mode looks at."""
    return rollup.where(since("bucket", as_of, days=days or MODES[mode][1]) & (F.col("bucket") < at(as_of)))


def ops_report(rollup: DataFrame, countries: DataFrame) -> DataFrame:
    """Totals, by method and by country in one pass; level tells which. ``countries`` has outlet_id and country."""
    rows = rollup.join(countries, "outlet_id", "left")
    sums = ("attempts", "successes", "failures", "fetched")
    found = rows.groupingSets([[], [F.col("method")], [F.col("country")]], F.col("method"), F.col("country")).agg(F.grouping_id().alias("level"), *(F.sum(c).alias(c) for c in sums))
    return found.withColumn("failure_pct", percent(F.col("failures"), F.col("attempts")))


def weekly_report(runs: DataFrame, countries: DataFrame, as_of: datetime, days: int = 7, top: int = 10) -> DataFrame:
    """The week's report as rows of (part, place, key, attempts, failures, failure_pct): totals, methods in fixed order, countries and feeds by failures, and why checks failed, each reason's share of all failures."""
    week = ops_window(ops_rollup(runs, MODES["weekly"][0]), as_of, "weekly", days)
    sums = [F.sum(c).alias(c) for c in ("attempts", "failures")]
    total = week.agg(*sums).select(F.lit("total").alias("part"), F.lit(1).alias("place"), F.when(F.col("failures") > 0, "degraded").otherwise("healthy").alias("key"), "attempts", "failures")
    method = week.groupBy("method").agg(*sums).select(F.lit("method").alias("part"), F.array_position(F.array(F.lit("rss"), F.lit("sitemap")), F.col("method")).cast("int").alias("place"), F.col("method").alias("key"), "attempts", "failures")

    def ranked(part: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        # a report's page is small: only its rows are numbered
        page = rows.orderBy(*order).limit(top)
        return page.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(*order)).alias("place"), "key", "attempts", "failures")

    by = [F.desc("failures"), F.desc("attempts"), F.col("key")]
    country = ranked("country", week.join(countries, "outlet_id", "left").groupBy(F.coalesce("country", F.lit("(unknown)")).alias("key")).agg(*sums), by)
    feed = ranked("feed", week.groupBy(F.concat_ws("/", F.col("outlet_id").cast("string"), "method").alias("key")).agg(*sums), by)
    failed = runs.where(since("ran_at", as_of, days=days) & (F.col("ran_at") < at(as_of)) & F.col("attempted") & ~F.col("ok"))
    why = failed.groupBy(F.concat_ws(":", "method", F.coalesce("error", F.lit("unknown"))).alias("key")).agg(F.count("*").alias("failures"))
    reason = ranked("reason", why.withColumn("attempts", failed.agg(F.count("*")).scalar()), by)
    rows = total.unionByName(method).unionByName(country).unionByName(feed).unionByName(reason)
    return rows.withColumn("failure_pct", percent(F.col("failures"), F.col("attempts")))


def top_failing(rollup: DataFrame, top: int = 10) -> DataFrame:
    per = rollup.groupBy("outlet_id", "method").agg(F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"))
    return per.withColumn("failure_pct", percent(F.col("failures"), F.col("attempts"))).orderBy(F.desc("failures"), F.desc("failure_pct"), "outlet_id", "method").limit(top)


#: Which reasons a weekly report names first; network errors come third, switched-off sitemaps last.
WEEKLY_FIRST = {"primary_invalid": 0, "html_returned": 1}


def failure_reasons(runs: DataFrame, as_of: datetime, hours: int = 24, country: str | None = None, method: str | None = None, outlets: tuple[int, ...] = (), weekly: bool = False) -> DataFrame:
    """Failures of the window by method and error, of a country, method or some outlets only if these are given, and their place: most first, or in the weekly report's order of priority."""
    failed = runs.where(since("ran_at", as_of, hours=hours) & F.col("attempted") & ~F.col("ok"))
    failed = failed if country is None else failed.where(F.col("country") == country)
    failed = failed if method is None else failed.where(F.col("method") == method)
    failed = failed.where(F.col("outlet_id").isin(*outlets)) if outlets else failed
    per = failed.groupBy(F.concat_ws(":", "method", F.coalesce("error", F.lit("unknown"))).alias("reason")).agg(F.count("*").alias("n"))
    bare = F.regexp_replace("reason", "^(rss|sitemap):", "")
    first = F.lit(None).cast("int")
    for name, place in WEEKLY_FIRST.items():
        first = F.when(bare == name, place).otherwise(first)
    priority = F.coalesce(first, F.when(F.startswith(bare, F.lit("network_error")), 2).when(F.startswith(bare, F.lit("sitemap_policy_disabled")), 4).otherwise(3)) if weekly else F.lit(3)
    order = Window.orderBy("priority", F.desc("n"), "reason")  # a row a reason
    return per.withColumn("priority", priority).withColumn("place", F.row_number().over(order))


def paged(rows: DataFrame, order: list[Column], page: int, size: int, updated: str, search: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """One page, each row with the number of rows and the newest update of the whole; totals are an aggregate of their own.

    A search keeps the rows that hold its text, in any case, in one of the columns, and is what the totals count.
    """
    if search:
        held = F.lit(False)
        for c in columns:
            held = held | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(search.lower()))
        rows = rows.where(held)
    one_page = rows.orderBy(*order).offset(page * size).limit(size)
    return one_page.withColumns({"total_count": rows.agg(F.count("*")).scalar(), "last_updated": rows.agg(F.max(updated)).scalar()})


def feed_lag(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Per outlet and method the hours since its newest item, or since it was last fetched."""
    per = runs.groupBy("outlet_id", "method").agg(F.max(F.when(F.col("ok"), F.col("newest_item_published_at"))).alias("last_publication"), F.max("ran_at").alias("last_fetched"))
    moment = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    lag = F.floor((F.unix_timestamp(moment.cast("timestamp")) - F.unix_timestamp(F.coalesce("last_publication", "last_fetched").cast("timestamp"))) / 3600)
    return per.withColumn("lag_hours", lag.cast("long"))


def endpoint_health(runs: DataFrame, as_of: datetime, stale_days: int = 7) -> DataFrame:
    """Of the newest check of each endpoint, per type: endpoints, healthy ones, and those whose newest item is old."""
    newest = runs.groupBy("outlet_id", "method").agg(F.max_by(F.struct("ok", "newest_item_published_at", "ran_at"), F.struct("ran_at", "id")).alias("x")).select("method", "x.*")
    stale = ~since("newest_item_published_at", as_of, days=stale_days)
    return newest.groupBy("method").agg(F.count("*").alias("endpoints"), F.count_if("ok").alias("healthy"), F.count_if(~F.col("ok")).alias("unhealthy"), F.count_if(F.col("ok") & stale).alias("stale"))
