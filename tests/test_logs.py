"""Logs from a database and the incremental export as a stream."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from coverline.plans import settled
from coverline.plans.views import articles, runs
from coverline.sources import registry
from coverline.sources.kept import keep


@pytest.fixture(scope="module")
def database(spark, small, tmp_path_factory):
    """The log of checks in the database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/logs;create=true"
    rows = runs(spark, small).withColumns({"outlet_id": F.col("outlet_id").cast("string"), "runner": F.lit("hourly"), "error": F.coalesce("error", F.lit("none"))})  # Spark cannot write a null text to Derby
    stored = rows.select(*(c.name for c in spark.createDataFrame([], registry.RUNS).schema))
    stored = stored.withColumns({c: F.col(c).cast("timestamp") for c in ("ran_at", "newest_item_published_at")})
    stored.write.format("jdbc").options(url=url, dbtable="RUNS", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", createTableColumnTypes="runner VARCHAR(40), outlet_id VARCHAR(40), source VARCHAR(80), method VARCHAR(20), country VARCHAR(80), error VARCHAR(200)").save()
    path = str(tmp_path_factory.mktemp("log") / "runs")
    rows.write.parquet(path)
    return url, path


def test_a_log_from_a_database_is_the_log_from_files(spark, database):
    url, path = database
    found = registry.read_jdbc(spark, url, "RUNS", registry.RUNS, "id", 5, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    files = registry.read_log(spark, path, registry.RUNS)
    assert found.schema == files.schema and found.rdd.getNumPartitions() == 5
    assert sorted(map(repr, found.collect())) == sorted(map(repr, files.collect()))
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) <= 2 * min(r["count"] for r in sizes)


def test_a_start_date_and_filters_are_the_databases_work(spark, database):
    url, path = database
    read = lambda **more: registry.read_jdbc(spark, url, "RUNS", registry.RUNS, "ran_at", 3, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", **more)
    found = read(since=datetime(2024, 1, 10), time_column="ran_at").where("method = 'rss'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "RAN_AT,2024-01-10" in pushed.replace("*", "").upper().replace(" ", "") or "GREATERTHANOREQUAL" in pushed.upper()
    assert "METHOD" in pushed.upper()
    files = registry.read_log(spark, path, registry.RUNS, since=datetime(2024, 1, 10), column="ran_at").where("method = 'rss'")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, files.collect()))


def test_an_empty_table_is_read_in_one_part(spark, database):
    url, _ = database
    found = registry.read_jdbc(spark, url, "(SELECT * FROM RUNS WHERE \"id\" < 0) nothing", registry.RUNS, "id", 5, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert found.collect() == []


def test_the_streamed_export_is_the_batch_export(spark, small):
    feed, behind = settled.export_run(spark, small)
    rows = articles(spark, small)
    first = rows.where(f"created_at < timestamp_ntz'1998-06-20' AND NOT ({settled.HELD})")
    start, end = datetime(1990, 1, 1), datetime(2000, 1, 1)
    one, cursor = registry.incremental_export(first, start, end)
    cursor = cursor.first().cursor
    two, last = registry.incremental_export(rows, cursor, end, settled.OVERLAP_HOURS * 3600)
    both = keep(one.unionByName(two), "both")
    order = F.struct("created_at", "title_original", "url")
    want = both.groupBy("external_id").agg(F.max(order).alias("x")).select("external_id", "x.*")
    assert feed.rows().exceptAll(want).isEmpty() and want.exceptAll(feed.rows()).isEmpty()
    assert feed.cursor() == last.first().cursor
    assert behind == rows.where(settled.HELD).where(F.col("created_at") < F.lit(cursor) - F.expr(f"INTERVAL '{settled.OVERLAP_HOURS}' HOUR")).count() > 0
    told = spark.read.parquet(f"{feed.folder}/rows")
    assert told.count() == told.select(*registry.EXPORT).distinct().count()  # nothing twice
