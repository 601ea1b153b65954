"""Country benchmark: what each source and country published, hourly and daily (A1 to A7), and its snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverline.functions.columns import at, basis_points, low_signal_title, present, within

UNKNOWN_COUNTRY = "(unknown)"
COUNTS = ("published", "fresh", "late", "inserted")


def clamped_publication() -> Column:
    return F.least("publication_datetime", "created_at")


def source_window_counts(articles: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Per (source_country, source): inserted in the last hour and the window, published, fresh and late."""
    pub = clamped_publication()
    created, published = within("created_at", start, end), within(pub, start, end)
    kept = articles.where(~low_signal_title(F.col("title_original"), F.col("url"), F.col("source"), F.col("title_quality")))
    kept = kept.where(created | within("publication_datetime", start, end))
    return kept.groupBy("source_country", "source").agg(
        F.count_if(within("created_at", end - timedelta(hours=1), end)).alias("inserted_1h"), F.count_if(created).alias("inserted"),
        F.count_if(published).alias("published"), F.count_if(created & published).alias("fresh"), F.count_if(created & (pub < at(start))).alias("late"),
    )


def resolve_country(rows: DataFrame, feeds: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``rows`` with country: the row's source_country under its registry name, else the registry's country of the source."""
    countries = feeds.select(F.lower("country").alias("__key"), F.col("country").alias("__name")).union(feeds.select(F.lower("code"), "country")).groupBy("__key").agg(F.min("__name").alias("__canonical"))
    exact = feeds.groupBy(F.col("source").alias("__source")).agg(F.min("country").alias("__exact"))
    loose = feeds.groupBy(F.lower(F.trim("source")).alias("__loose_source")).agg(F.min("country").alias("__loose"))
    out = rows.join(countries, F.lower(present("source_country")) == F.col("__key"), "left").join(exact, F.col("source") == F.col("__source"), "left")
    out = out.join(loose, F.lower(F.trim("source")) == F.col("__loose_source"), "left")
    last = [] if fallback is None else [fallback]
    chosen = F.coalesce("__canonical", present("source_country"), "__exact", "__loose", *last, F.lit(UNKNOWN_COUNTRY))
    return out.select(*(rows[c] for c in rows.columns if c != "resolved_country"), chosen.alias("resolved_country"))


def per_country_source(counts: DataFrame, feeds: DataFrame) -> DataFrame:
    values = [c for c in counts.columns if c not in ("source_country", "source")]
    return resolve_country(counts, feeds).groupBy(F.col("resolved_country").alias("country"), "source").agg(*(F.sum(v).alias(v) for v in values))


def country_totals(sources: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Totals, active sources and the share of the top 1, 5 and 10 sources, from rows of (keys, source, counts)."""
    values = [c for c in sources.columns if c not in (*keys, "source")]
    ranked = sources.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("published"), "source")))
    top = lambda k: F.sum(F.when(F.col("__rank") <= k, F.col("published")).otherwise(0))
    total = F.sum("published")
    extra = [F.count_if(F.col("inserted_1h") > 0).alias("active_sources_1h")] if "inserted_1h" in values else []
    return ranked.groupBy(*keys).agg(
        *(F.sum(v).alias(v) for v in values), F.count_if((F.col("published") > 0) | (F.col("inserted") > 0)).alias("active_sources"), *extra,
        *(basis_points(top(k), total).alias(f"top{k}_share_bps") for k in (1, 5, 10)),
    )


def country_benchmark_hourly(articles: DataFrame, feeds: DataFrame, as_of: datetime) -> DataFrame:
    """Per country over the 24 hours before the hour of ``as_of``."""
    end = as_of.replace(minute=0, second=0, microsecond=0)
    found = country_totals(per_country_source(source_window_counts(articles, end - timedelta(hours=24), end), feeds))
    return found.withColumn("bucket", at(end))


def window_ends(moment: Column, hours: int = 24) -> Column:
    """The full hours whose preceding ``hours`` hours hold the moment; none for a null."""
    hour = F.date_trunc("hour", moment).cast("timestamp_ntz")
    ends = F.sequence(hour + F.expr("INTERVAL '1' HOUR"), hour + F.expr(f"INTERVAL '{hours}' HOUR"), F.expr("INTERVAL '1' HOUR"))
    return F.when(moment.isNotNull(), ends).otherwise(F.array().cast("array<timestamp_ntz>"))


def days_of(articles: DataFrame) -> DataFrame:
    """(day): the days of the buckets of ``benchmark_hours`` that ``articles`` count in."""
    hours = articles.select(F.explode(F.array(*(F.date_trunc("hour", c).cast("timestamp_ntz") for c in ("created_at", "publication_datetime")))).alias("hour")).distinct()
    return hours.select(F.explode(window_ends(F.col("hour"))).alias("bucket")).select(F.to_date("bucket").alias("day")).distinct()


def _hours_of(articles: DataFrame) -> DataFrame:
    """Per (source_country, source) and hour: how many articles were created and published in it, how many of these can be
    fresh in any bucket, and how many it has by the publication as it stands (``told``)."""
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    rows = articles.select("source_country", "source", hour("created_at").alias("hc"), hour("publication_datetime").alias("hq")).withColumn("hp", F.least("hc", "hq"))
    can = F.coalesce(F.col("hp") + F.expr("INTERVAL '23' HOUR") >= F.col("hc"), F.lit(False))
    rows = rows.withColumns({"can": can.cast("long"), "by_created": (F.coalesce(F.col("hp") == F.col("hc"), F.lit(False))).cast("long")})
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    event = lambda h, **n: F.struct(F.col(h).alias("hour"), *(n.get(c, zero).alias(c) for c in ("created", "created_can", "published", "published_can", "told")))
    at_created = event("hc", created=one, created_can=F.col("can"), published=F.col("by_created"), published_can=F.col("by_created") * F.col("can"))
    at_told = event("hq", published=one - F.col("by_created"), published_can=(one - F.col("by_created")) * F.col("can"), told=one)
    events = rows.select("source_country", "source", F.inline(F.array(at_created, at_told))).where("hour is not null")
    return events.groupBy("source_country", "source", "hour").agg(*(F.sum(c).alias(c) for c in ("created", "created_can", "published", "published_can", "told")))


def benchmark_hours(articles: DataFrame, feeds: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """``country_benchmark_hourly`` at every full hour at once, or those of some ``days`` (day).

    All bounds are full hours, so a source's articles are first counted by hour. An hour's counts come into the buckets from
    the next hour on and leave them 24 hours later (those of the last hour: one later); an article published ``p`` and created ``c``
    is fresh from ``c`` until 24 hours after ``p``, and late from then until 24 hours after ``c``. So a source's buckets are
    running sums over what comes and goes, and no article is spread over the buckets it counts in.
    """
    kept = articles.where(~low_signal_title(F.col("title_original"), F.col("url"), F.col("source"), F.col("title_quality")))
    hours = resolve_country(_hours_of(kept), feeds).withColumnRenamed("resolved_country", "country").repartition("country", "source")
    values = ("inserted_1h", "inserted", "published", "fresh", "late", "told")
    n, zero = F.col, F.lit(0).cast("long")
    never = n("created") - n("created_can")
    step = lambda after, **by: F.struct((n("hour") + F.expr(f"INTERVAL '{after}' HOUR")).alias("bucket"), *(by.get(v, zero).alias(v) for v in values))
    steps = F.array(
        step(1, inserted_1h=n("created"), inserted=n("created"), published=n("published"), fresh=n("created_can"), late=never, told=n("told")), step(2, inserted_1h=-n("created")),
        step(25, inserted=-n("created"), published=-n("published"), fresh=-n("published_can"), late=n("published_can") - n("created"), told=-n("told")),
    )
    changes = hours.select("country", "source", F.inline(steps)).groupBy("country", "source", "bucket").agg(*(F.sum(v).alias(v) for v in values))
    along = Window.partitionBy("country", "source").orderBy("bucket")
    sums = changes.select("country", "source", "bucket", F.lead("bucket").over(along).alias("next"), *(F.sum(v).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(v) for v in values))
    hour = F.expr("INTERVAL '1' HOUR")
    counts = sums.where("inserted > 0 or told > 0").withColumn("bucket", F.explode(F.sequence("bucket", F.col("next") - hour, hour))).drop("next", "told")
    if days is not None:
        counts = counts.join(F.broadcast(days), F.to_date("bucket") == F.col("day"), "left_semi")
    return country_totals(counts, ("bucket", "country"))


def source_daily(articles: DataFrame, feeds: DataFrame, day: datetime) -> DataFrame:
    counts = source_window_counts(articles, day, day + timedelta(days=1)).drop("inserted_1h")
    return per_country_source(counts, feeds).withColumn("bucket", at(day))


def country_benchmark_daily(articles: DataFrame, feeds: DataFrame, day: datetime) -> DataFrame:
    return country_totals(source_daily(articles, feeds, day).drop("bucket")).withColumn("bucket", at(day))


def benchmark_days(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every day's benchmark at once: an article counts on the days of its clamped publication and of its creation."""
    pub = clamped_publication()
    kept = articles.where(~low_signal_title(F.col("title_original"), F.col("url"), F.col("source"), F.col("title_quality")))
    day_of = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    days = F.array_distinct(F.array(day_of(F.col("created_at")), day_of(pub)))
    rows = kept.select("source_country", "source", pub.alias("pub"), "created_at", F.explode(days).alias("bucket"))
    created, published = day_of(F.col("created_at")) == F.col("bucket"), day_of(F.col("pub")) == F.col("bucket")
    counts = rows.groupBy("bucket", "source_country", "source").agg(
        F.count_if(created).alias("inserted"), F.count_if(published).alias("published"), F.count_if(created & published).alias("fresh"), F.count_if(created & (F.col("pub") < F.col("bucket"))).alias("late"),
    )
    named = resolve_country(counts, feeds).groupBy("bucket", F.col("resolved_country").alias("country"), "source").agg(*(F.sum(c).alias(c) for c in ("inserted", "published", "fresh", "late")))
    ranked = named.withColumn("__rank", F.row_number().over(Window.partitionBy("bucket", "country").orderBy(F.desc("published"), "source")))
    top = lambda k: F.sum(F.when(F.col("__rank") <= k, F.col("published")).otherwise(0))
    return ranked.groupBy("bucket", "country").agg(*(F.sum(c).alias(c) for c in COUNTS), F.count_if((F.col("published") > 0) | (F.col("inserted") > 0)).alias("active_sources"), *(basis_points(top(k), F.sum("published")).alias(f"top{k}_share_bps") for k in (1, 5, 10)))


def benchmark_latest(bench: DataFrame) -> DataFrame:
    """Newest bucket of each metric version, with the number of its rows."""
    newest = bench.groupBy("metric_version").agg(F.max("bucket").alias("bucket"))
    return bench.join(newest, ["metric_version", "bucket"], "left_semi").groupBy("metric_version", "bucket").agg(F.count("*").alias("n_countries"), F.sum("published").alias("published"))


def period_start(bucket: Column, unit: str) -> Column:
    """First day of the month, or of the month's week (days 1 to 7, 8 to 14, ...)."""
    month = F.date_trunc("month", bucket).cast("timestamp_ntz")
    if unit == "month":
        return month
    return F.make_timestamp_ntz(F.year(bucket), F.month(bucket), F.floor((F.dayofmonth(bucket) - 1) / 7).cast("int") * 7 + 1, F.lit(0), F.lit(0), F.lit(0))


def benchmark_range(days: DataFrame, unit: str) -> DataFrame:
    """Sums, rounded mean of active sources, and shares weighted by what was published, per week of month or month."""
    weighted = lambda c: F.when(F.sum("published") > 0, F.floor((2 * F.sum(F.col(c) * F.col("published")) + F.sum("published")) / (2 * F.sum("published")))).otherwise(0).cast("long")
    mean = F.floor((2 * F.sum("active_sources") + F.count("*")) / (2 * F.count("*"))).cast("long")
    return days.groupBy(period_start(F.col("bucket"), unit).alias("period"), "country").agg(*(F.sum(c).alias(c) for c in COUNTS), mean.alias("active_sources"), *(weighted(f"top{k}_share_bps").alias(f"top{k}_share_bps") for k in (1, 5, 10)), F.count("*").alias("n_days"))


def benchmark_wide(hourly: DataFrame, daily: DataFrame, weekly: DataFrame, monthly: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per country with published and inserted of every part, missing ones 0, and a row of totals."""
    part = lambda df, name: df.groupBy("country").agg(F.sum("published").alias(f"published_{name}"), F.sum("inserted").alias(f"inserted_{name}"))
    parts = [part(df, name) for df, name in ((hourly, "24h"), (daily, "day"), (weekly, "week"), (monthly, "month"))]
    wide = parts[0].join(parts[1], "country", "full").join(parts[2], "country", "full").join(parts[3], "country", "full")
    values = [c for c in wide.columns if c != "country"]
    codes = feeds.groupBy("country").agg(F.min("code").alias("code"))
    wide = wide.join(codes, "country", "left").select("country", "code", *(F.coalesce(c, F.lit(0)).alias(c) for c in values))
    total = wide.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in values)).select(F.lit("(total)").alias("country"), F.lit(None).cast("string").alias("code"), *values)
    return wide.unionByName(total)


def benchmark_parity(stored: DataFrame, recomputed: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Each (keys, field) on which the two differ, a side that lacks the row as null."""
    a = stored.select(*keys, F.lit(1).alias("in_stored"), *(F.col(f).alias(f"stored_{f}") for f in fields))
    b = recomputed.select(*keys, F.lit(1).alias("in_recomputed"), *(F.col(f).alias(f"recomputed_{f}") for f in fields))
    both = a.join(b, keys, "full")
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"stored_{f}").cast("long").alias("stored"), F.col(f"recomputed_{f}").cast("long").alias("recomputed")) for f in fields)))
    kind = F.when(F.col("in_stored").isNull(), "missing_in_stored").when(F.col("in_recomputed").isNull(), "missing_in_recomputed").otherwise("mismatch")
    return both.select(*keys, kind.alias("kind"), rows.alias("x")).select(*keys, "kind", "x.*").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def write_snapshot(df: DataFrame, path: str, bucket: str, metric_version: str) -> None:
    """Replace exactly one (bucket, metric_version) slice of a snapshot folder; writing it again changes nothing."""
    write_snapshots(df.withColumn("bucket_key", F.lit(bucket)), path, metric_version)


def write_snapshots(df: DataFrame, path: str, metric_version: str) -> None:
    """Replace the slices of all ``bucket_key`` in ``df``, and no other."""
    marked = df.withColumn("metric_version", F.lit(metric_version))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_key", "metric_version").parquet(path)
