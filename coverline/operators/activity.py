"""First discovery of links: per scope, against baselines, over days and months (L1 to L4)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions.columns import at
from coverline.functions.urls import article_kind, article_url

GOOD = ("working_nonempty", "valid_empty")


def collected(observations: DataFrame) -> DataFrame:
    """One row for each collection id (replays are ignored), with useful: successful and no index of sitemaps."""
    once = observations.groupBy("id").agg(F.min_by(F.struct(*(c for c in observations.columns if c != "id")), F.col("checked_at")).alias("x")).select("id", "x.*")
    return once.withColumn("useful", F.col("status").isin(*GOOD) & (F.coalesce("format", F.lit("")) != "sitemapindex"))


def seen_links(collections: DataFrame) -> DataFrame:
    """(id, endpoint, checked_at, source_id, country, url) of useful collections: links in one form, once for each collection."""
    useful = collections.where("useful")
    links = useful.select("id", "endpoint_id", "checked_at", F.explode(F.array_distinct(F.transform("urls", article_url))).alias("url"), "sources")
    return links.select("id", "endpoint_id", "checked_at", "url", F.explode("sources").alias("s")).select("id", "endpoint_id", "checked_at", "url", "s.source_id", "s.country")


def first_last_seen(collections: DataFrame, scope: str) -> DataFrame:
    """Per scope (url, endpoint, binding, source or country) and link: first and last seen."""
    keys = {"url": [], "endpoint": ["endpoint_id"], "binding": ["source_id", "endpoint_id"], "source": ["source_id"], "country": ["country"]}[scope]
    return seen_links(collections).groupBy(*keys, "url").agg(F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_seen"))


def baselines(collections: DataFrame) -> DataFrame:
    """When each binding (source, endpoint) was first checked usefully; an empty but valid document counts."""
    rows = collections.where("useful").select("id", "endpoint_id", "checked_at", F.explode("sources").alias("s"))
    return rows.groupBy("s.source_id", "s.country", "endpoint_id").agg(F.min(F.struct("checked_at", "id")).alias("baseline"))


def new_candidates(collections: DataFrame, scope: str) -> DataFrame:
    """Per scope (source or country) the links that are NEW, with the collection that found them.

    A link counts when the scope sees it for the first time, it looks like an article, and the binding had its baseline
    before that collection; for a country no binding of it on the endpoint may be without one.
    """
    key = "source_id" if scope == "source" else "country"
    links, base = seen_links(collections), baselines(collections)
    known = links.join(base.select("source_id", "endpoint_id", "baseline"), ["source_id", "endpoint_id"])
    known = known.withColumn("before", F.col("baseline") < F.struct("checked_at", "id"))
    per = known.groupBy(key, "url", "id", "checked_at", "endpoint_id").agg(F.bool_and("before").alias("before"))
    first = per.groupBy(key, "url").agg(F.min_by(F.struct("id", "endpoint_id", "before", "checked_at"), F.struct("checked_at", "id")).alias("x")).select(key, "url", "x.*")
    return first.where(F.col("before") & (article_kind(F.col("url")) == "candidate")).select(key, "url", "id", "endpoint_id", "checked_at")


#: Most days of one report.
MOST_DAYS = 31


def day_spine(scopes: DataFrame, start: date, end: date, zone: str) -> DataFrame:
    """``scopes`` with every local day from start to end and its bounds in UTC; a day with a clock change has 23 or 25 hours."""
    if start > end or (end - start).days >= MOST_DAYS:
        raise ValueError(f"a range of 1 to {MOST_DAYS} days is needed, not {start} to {end}")
    days = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")
    first = lambda day: F.to_utc_timestamp(day.cast("timestamp_ntz").cast("timestamp"), zone).cast("timestamp_ntz")
    return scopes.select("*", days).withColumns({"day_from": first(F.col("day")), "day_to": first(F.date_add("day", 1))})


def activity_periods(new: DataFrame, collections: DataFrame, bindings: DataFrame, key: str, zone: str, start: date, end: date, available_since: datetime) -> DataFrame:
    """Per scope and local calendar day, whether or not anything was checked: new links, endpoints expected, targeted and successful, failed and index-only checks, and how complete the day is.

    ``bindings`` has the scope's column, endpoint_id, since and until (null while it holds): an endpoint is expected on a day that one of its
    bindings overlaps. A day is not_tracked before the scope's first check, history_not_in_snapshot if it begins before
    ``available_since``, not_collected without checks, failed_or_index_only without a useful one, partial until every expected
    endpoint had one, then complete. New links are null where the day cannot tell. Days come from the registry's scopes, so
    what is joined is at most ``MOST_DAYS`` rows for each; the session's zone must be UTC.
    """
    rows = collections.select("id", "endpoint_id", "checked_at", "useful", "status", "format", F.explode("sources").alias("s")).select("id", "endpoint_id", "checked_at", "useful", "status", "format", "s.source_id", "s.country")
    local = lambda c: F.to_date(F.from_utc_timestamp(c.cast("timestamp"), zone))
    inside = local(F.col("checked_at")).between(F.lit(start), F.lit(end))
    checks = rows.where(inside).groupBy(key, local(F.col("checked_at")).alias("day")).agg(
        F.countDistinct("endpoint_id").alias("targeted"), F.countDistinct(F.when(F.col("useful"), F.col("endpoint_id"))).alias("successful"),
        F.countDistinct(F.when(~F.col("status").isin(*GOOD), F.col("id"))).alias("failed_checks"), F.countDistinct(F.when(F.col("format") == "sitemapindex", F.col("id"))).alias("index_only_checks"),
    )
    began = rows.groupBy(key).agg(F.min("checked_at").alias("began"))
    spine = day_spine(bindings.select(key).distinct(), start, end, zone)
    held = spine.join(bindings, key).where((F.col("since") < F.col("day_to")) & (F.col("until").isNull() | (F.col("until") > F.col("day_from"))))
    expected = held.groupBy(key, "day").agg(F.countDistinct("endpoint_id").alias("expected"))
    found = new.where(inside).groupBy(key, local(F.col("checked_at")).alias("day")).agg(F.count("*").alias("new"))
    out = spine.join(began, key, "left").join(expected, [key, "day"], "left").join(checks, [key, "day"], "left").join(found, [key, "day"], "left")
    counts = ("expected", "targeted", "successful", "failed_checks", "index_only_checks")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    state = (
        F.when(F.col("began").isNull() | (F.col("day_to") <= F.col("began")), "not_tracked").when(F.col("day_from") < at(available_since), "history_not_in_snapshot").when(F.col("targeted") == 0, "not_collected")
        .when(F.col("successful") == 0, "failed_or_index_only").when(F.col("successful") < F.col("expected"), "partial").otherwise("complete")
    )
    told = state.isin("partial", "complete")
    return out.select(key, "day", "day_from", "day_to", state.alias("state"), F.when(told, F.coalesce("new", F.lit(0))).alias("new"), *counts)


def rolling_new(new: DataFrame, key: str, end: Column, hours: int = 24) -> DataFrame:
    since = (end.cast("timestamp").cast("long") - hours * 3600).cast("timestamp").cast("timestamp_ntz")
    return new.where((F.col("checked_at") >= since) & (F.col("checked_at") < end)).groupBy(key).agg(F.count("*").alias("new"))


def activity_archive(new: DataFrame, key: str) -> DataFrame:
    """Per month and scope the number of records, first and last; the records themselves are written by month."""
    return new.groupBy(F.date_format("checked_at", "yyyy-MM").alias("month"), key).agg(F.count("*").alias("n_records"), F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_seen"))


def write_archive(new: DataFrame, path: str) -> None:
    new.withColumn("month", F.date_format("checked_at", "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
