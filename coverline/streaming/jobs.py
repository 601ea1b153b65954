"""Structured Streaming forms of the jobs (ST1 to ST6); each has a batch twin that gives the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from coverline.functions.columns import at, within


#: State that is larger than memory, and processors with several states, need this store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Feeds share the state of one of so many groups.
GROUPS = 1_024


def rollup(runs: DataFrame, unit: str = "1 hour", late: str | None = None) -> DataFrame:
    """Additive counters of checks per (bucket, runner, outlet, method); for a stream ``late`` says how long a bucket stays open."""
    rows = runs.where("attempted")
    rows = rows if late is None else rows.withWatermark("ran_at", late)
    found = rows.groupBy(F.window("ran_at", unit), "runner", "outlet_id", "method").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"), F.sum("fetched_count").alias("fetched"))
    return found.select(F.col("window.start").alias("bucket"), "runner", "outlet_id", "method", "attempts", "successes", "failures", "fetched")


def _kept(published: Column, mark: Column, as_of: datetime, max_age_days: int, backfill: tuple[datetime, datetime] | None, ignore_watermark: bool) -> Column:
    """Whether an item passes: newer than the watermark and the age limit, or undated; in a backfill dated inside its window."""
    newer = published.isNull() | (published > F.greatest(mark, at(as_of) - F.expr(f"INTERVAL '{max_age_days}' DAY")))
    passes = F.lit(True) if ignore_watermark else newer
    return passes if backfill is None else passes & F.coalesce(within(published, *backfill), F.lit(False))


def new_items(items: DataFrame, watermarks: DataFrame, as_of: datetime, max_age_days: int = 14, backfill: tuple[datetime, datetime] | None = None, ignore_watermark: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items newer than their feed's watermark or the age limit, whichever is later (undated ones pass), and the watermarks after them.

    A ``backfill`` (from, to) keeps only items dated in it; with ``ignore_watermark`` old ones too. Watermarks never go back.
    """
    keys = ["outlet_id", "method"]
    known = items.join(watermarks, keys, "left")
    kept = known.where(_kept(F.col("published_at"), F.col("last_publication_at"), as_of, max_age_days, backfill, ignore_watermark)).select(*items.columns)
    seen = kept.groupBy(*keys).agg(F.max("published_at").alias("seen"))
    after = watermarks.join(seen, keys, "full").select(*keys, F.greatest("last_publication_at", "seen").alias("last_publication_at"))
    return kept, after


def dedupe(items: DataFrame, late: str | None = None) -> DataFrame:
    """One row per article; a stream keeps the first arrival within its watermark and leaves the preferred copy to the upsert."""
    if late is not None:
        return items.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["external_id"])
    return items.dropDuplicates(["external_id"])


def new_items_stream(items: DataFrame, as_of: datetime, max_age_days: int = 14, backfill: tuple[datetime, datetime] | None = None, ignore_watermark: bool = False) -> DataFrame:
    """``new_items`` over a stream of (id, outlet_id, method, published_at, last_publication_at): feeds' watermarks are keyed state.

    A feed's first batch starts from the watermark that its rows bring (``last_publication_at``, null for none). Items of a
    batch are held against the watermark before it, which then moves to the newest of them. Batches of rows stream past.
    Feeds share the state of one of ``GROUPS``, as each group costs a fixed time a batch.
    """
    oldest = pd.Timestamp(as_of) - pd.Timedelta(days=max_age_days)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks = {feed: pd.Timestamp(mark) if mark else None for feed, mark in json.loads(state.get[0])} if state.exists else {}
        known, after = set(marks), dict(marks)
        for rows in batches:
            brought = rows.groupby("feed")["last_publication_at"].max()
            for feed, mark in brought.items():
                if feed not in known and marks.get(feed) is None:
                    marks[feed] = after[feed] = None if pd.isna(mark) else max(mark, after.get(feed) or mark)
            cut = rows["feed"].map({feed: oldest if marks[feed] is None else max(marks[feed], oldest) for feed in brought.index})
            kept = rows if ignore_watermark else rows[rows["published_at"].isna() | (rows["published_at"] > cut)]
            if backfill is not None:
                kept = kept[(kept["published_at"] >= pd.Timestamp(backfill[0])) & (kept["published_at"] < pd.Timestamp(backfill[1]))]
            for feed, newest in kept.groupby("feed")["published_at"].max().dropna().items():
                after[feed] = newest if after[feed] is None else max(after[feed], newest)
            yield kept[["id", "feed", "published_at"]]
        state.update((json.dumps([(feed, mark.isoformat() if mark is not None else None) for feed, mark in after.items()]),))

    feed = F.to_json(F.struct("outlet_id", "method"))  # no two feeds have one name, and a missing part is told from an empty one
    rows = items.select(F.pmod(F.xxhash64("outlet_id", "method"), F.lit(GROUPS)).alias("group"), feed.alias("feed"), "id", "published_at", "last_publication_at")
    out = "id long, feed string, published_at timestamp_ntz"
    kept = rows.groupBy("group").applyInPandasWithState(update, out, "marks string", "append", GroupStateTimeout.NoTimeout)
    return kept.withColumn("f", F.from_json("feed", "outlet_id long, method string")).select("id", "f.outlet_id", "f.method", "published_at")


def backoff(runs: DataFrame, late: str | None = None, min_attempts: int = 3, min_fail_pct: int = 60) -> DataFrame:
    """Feeds that nearly always fail within an hour that slides by five minutes."""
    rows = runs.where("attempted")
    rows = rows if late is None else rows.withWatermark("ran_at", late)
    found = rows.groupBy(F.window("ran_at", "60 minutes", "5 minutes"), "source", "method").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    return found.where((F.col("attempts") >= min_attempts) & (F.col("failures") * 100 >= min_fail_pct * F.col("attempts"))).select(F.col("window.start").alias("since"), "source", "method", "attempts", "failures")


def benchmark_stream(articles: DataFrame, late: str | None = None, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Live counts per country and window of creation, tumbling or sliding (24 hours by one hour, say); exact snapshots are recomputed per batch from the table.

    An article is late if it was published before the hour it was created in. Rows behind a stream's watermark are dropped;
    ``drained`` counts them.
    """
    rows = articles if late is None else articles.withWatermark("created_at", late)
    pub = F.least("publication_datetime", "created_at")
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    window = F.window("created_at", size) if slide is None else F.window("created_at", size, slide)
    found = rows.withColumns({"is_late": pub < hour}).groupBy(window, "country").agg(F.count("*").alias("inserted"), F.count_if("is_late").alias("late"))
    return found.select(F.col("window.start").alias("bucket"), "country", "inserted", "late")


def drained(spark: SparkSession, source: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, checkpoint: str) -> DataFrame:
    """Run a streaming job over all that its source holds now and return its table of results.

    In update mode a key's rows of later batches follow its earlier ones; ``batch`` tells which. How many rows came behind
    the watermark and were dropped is in the table's ``dropped`` attribute.
    """
    out = f"{checkpoint}/out-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    frame = job(source)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    running.awaitTermination()
    schema = StructType([*frame.schema.fields, StructField("batch", IntegerType())])
    found = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    found.dropped = sum(operator.numRowsDroppedByWatermark for progress in running.recentProgress for operator in progress.stateOperators)
    return found


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an updating stream's results the newest row of each key."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")
