"""The registry of outlets, typed readers and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.functions.columns import at, present
from coverline.functions.urls import normalize_link
from coverline.sources.kept import exists, repeated

REGISTRY = """countries array<struct<name string, code string, feeds array<struct<name string, url string, sitemapUrl string, enabled boolean, category string, language string, tier int, distributionClass string>>>>"""
ARTICLES = """external_id string, stable_id string, publication_datetime timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, title_original string, title_quality string, snippet_original string, country string, source_country string, url string, source string,
language string, primary_section string, sections_normalized array<string>, feed_categories array<string>, primary_topic string, topics array<string>, section_candidates array<struct<label string, score double, reasons array<string>>>"""
RUNS = """id long, ran_at timestamp_ntz, runner string, outlet_id string, source string, method string, country string, attempted boolean, ok boolean, status_code int, fetched_count int, response_ms int, newest_item_published_at timestamp_ntz, error string"""


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per registration of a feed; blank names are left out."""
    found = spark.read.schema(REGISTRY).option("multiLine", True).json(path)
    rows = found.select(F.explode("countries").alias("c")).select(F.trim("c.name").alias("country"), F.trim("c.code").alias("code"), F.explode("c.feeds").alias("f"))
    out = rows.select("country", "code", F.trim("f.name").alias("source"), present(F.col("f.url")).alias("rss_url"), present(F.col("f.sitemapUrl")).alias("sitemap_url"), F.coalesce("f.enabled", F.lit(True)).alias("enabled"), F.col("f.distributionClass").alias("distribution_class"), "f.category", "f.language", "f.tier")
    return out.where(F.col("source") != "")


def read_log(spark: SparkSession, path: str, schema: str, format: str = "parquet", since: datetime | None = None, column: str = "created_at") -> DataFrame:
    """A log under its schema, from Parquet or JSON lines; a start date reaches the scan as a filter."""
    rows = spark.read.schema(schema).format(format).load(path)
    return rows if since is None else rows.where(F.col(column) >= at(since))


def read_jdbc(spark: SparkSession, url: str, table: str, schema: str, column: str, partitions: int, since: datetime | None = None, time_column: str = "created_at", quote: str = '"', **options: str) -> DataFrame:
    """A log from a database under its schema, read in ``partitions`` ranges of a number or time column.

    The ranges run from the column's least to its greatest value, which the database is asked for; rows without a value are in the
    first. A start date, and filters that follow, are the database's work. Columns are met by name, whatever their case (``quote`` is
    what the database puts around names); the schema's types are cast to, and an array must be stored as JSON.
    """
    reader = lambda source: spark.read.format("jdbc").options(url=url, dbtable=source, **options)
    found = reader(table)
    names = {c.lower(): c for c in found.load().columns}
    column, time_column = names[column.lower()], names.get(time_column.lower(), time_column)
    name = f"{quote}{column}{quote}"
    low, high = reader(f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}) bounds").load().first()
    if low is not None and low != high:
        found = found.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=partitions)
    rows = found.load()
    if since is not None:
        # a database's times may come with the session's zone; the literal is cast to their type, so that the filter reaches it
        rows = rows.where(F.col(time_column) >= F.lit(since.isoformat(sep=" ")).cast(rows.schema[time_column].dataType))
    value = lambda f: F.from_json(F.col(f.name), f.dataType.simpleString()) if f.dataType.typeName() == "array" else F.col(f.name).cast(f.dataType)
    return rows.select(*(value(f).alias(f.name) for f in spark.createDataFrame([], schema).schema))


def endpoint_id(kind: Column, url: Column) -> Column:
    return F.concat(F.lit("ep_"), F.substring(F.sha2(F.concat_ws("|", kind, url), 256), 1, 24))


def normalize_registry(feeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, endpoints and their links; repeated registrations merge with counts, and conflicting states are unknown."""
    kinds = F.explode(F.array(F.struct(F.lit("rss").alias("type"), F.col("rss_url").alias("raw")), F.struct(F.lit("sitemap").alias("type"), F.col("sitemap_url").alias("raw"))))
    rows = feeds.select("country", F.lower(F.trim("source")).alias("name"), "enabled", kinds.alias("e")).select("country", "name", "enabled", "e.type", normalize_link(F.col("e.raw")).alias("url")).where(F.col("url") != "")
    rows = rows.withColumn("endpoint_id", endpoint_id(F.col("type"), F.col("url")))
    endpoints = rows.groupBy("endpoint_id", "type", "url").agg(F.count_if("enabled").alias("active"), F.count_if(~F.col("enabled")).alias("disabled"))
    status = F.when((F.col("active") > 0) & (F.col("disabled") > 0), "unknown").when(F.col("active") > 0, "active").otherwise("disabled")
    endpoints = endpoints.withColumn("status", status)
    sources = rows.groupBy("country", "name").agg(F.array_sort(F.collect_set("endpoint_id")).alias("ids"))
    sources = sources.select("country", "name", F.size("ids").cast("long").alias("n_endpoints"), F.concat(F.lit("src_"), F.substring(F.sha2(F.concat_ws("|", "country", "name", F.array_join("ids", ",")), 256), 1, 24)).alias("source_id"))
    links = rows.join(sources, ["country", "name"]).select("source_id", "endpoint_id").distinct()
    return sources, endpoints, links


def export_catalog(feeds: DataFrame, audit: DataFrame) -> DataFrame:
    """Enabled registrations with an endpoint, as rows for ``write.csv``, with the newest audit of each (country, source, feed link).

    ``audit`` has country, source, url, checked_at, id, ok and status_code. The state is valid or invalid as the audit found, invalid
    (ERR) if it got no status code, and without an audit what the registration says of itself in ``valid`` or ``status``, if it
    has such columns, else that it needs verification. Only feeds are audited; the endpoint of a registration without one is its sitemap.
    """
    facts = F.struct("status_code", "ok", "checked_at")
    newest = audit.groupBy("country", "source", "url").agg(F.max_by(facts, F.struct("checked_at", "id")).alias("audit")).withColumnRenamed("url", "rss_url")
    own = [present(c) for c in ("valid", "status") if c in feeds.columns]
    verify = F.lit("needs verification")
    said = F.when(F.col("rss_url").isNull(), verify).otherwise(F.coalesce(*own, verify))
    state = F.when(F.col("audit").isNull(), said).when(F.col("audit.status_code").isNull(), "invalid (ERR)").when(F.col("audit.ok"), "valid").otherwise("invalid")
    rows = feeds.withColumn("endpoint", F.coalesce(present("rss_url"), present("sitemap_url"))).where(F.coalesce("enabled", F.lit(True)) & F.col("endpoint").isNotNull())
    return rows.join(newest, ["country", "source", "rss_url"], "left").select(
        F.col("code").alias("country_code"), F.col("country").alias("country_name"), F.col("source").alias("outlet"), F.col("endpoint").alias("url"), state.alias("health_status"), F.coalesce(F.col("audit.status_code").cast("string"), F.lit("N/A")).alias("http_status"), F.col("audit.checked_at").alias("checked_at"),
    )


def incremental_export(articles: DataFrame, last_to: datetime, to: datetime, overlap_seconds: int = 120) -> tuple[DataFrame, DataFrame]:
    """Rows created since the last cursor less an overlap, one for each id, and the next cursor."""
    rows = articles.where((F.col("created_at") >= at(last_to - timedelta(seconds=overlap_seconds))) & (F.col("created_at") < at(to)))
    return _newest(rows), rows.agg(F.coalesce(F.max("created_at"), at(last_to)).alias("cursor"))


EXPORT = ("external_id", "created_at", "title_original", "url", "country")


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("external_id").agg(F.max(F.struct("created_at", "title_original", "url", "country")).alias("x")).select("external_id", "x.created_at", "x.title_original", "x.url")


class ExportFeed:
    """``incremental_export`` as a stream into ``folder``: rows by batch and the cursor after each.

    What was told once within the overlap is not told again: a batch is held against the rows that earlier ones told since the
    cursor less the overlap. Rows before that are dropped, as the batch form drops them, and counted. A batch that comes
    again replaces its own files.

    Most rows are unlike all others, and most ids are told once. So hashes and ids are counted first, and only rows that share
    one with another are shuffled whole.
    """

    def __init__(self, spark: SparkSession, folder: str, overlap_seconds: int = 120):
        self.spark, self.folder, self.overlap = spark, folder.rstrip("/"), overlap_seconds

    def _told(self) -> DataFrame:
        types = {"created_at": "timestamp_ntz"}
        return self.spark.read.schema(", ".join(f"{c} {types.get(c, 'string')}" for c in EXPORT) + ", batch int").parquet(f"{self.folder}/rows")

    def _notes(self) -> DataFrame:
        return self.spark.read.schema("cursor timestamp_ntz, behind long, batch int").parquet(f"{self.folder}/cursors")

    def fresh(self, rows: DataFrame, edge: datetime | None, batch: int) -> DataFrame:
        """The distinct rows since ``edge`` that no earlier batch told."""
        rows = rows.select(*EXPORT).where(F.col("created_at").isNotNull() if edge is None else F.col("created_at") >= at(edge))
        both = rows.withColumn("told", F.lit(0))
        if edge is not None:
            both = both.unionByName(self._told().where((F.col("batch") < batch) & (F.col("created_at") >= at(edge))).select(*EXPORT, F.lit(1).alias("told")))
        once = lambda rows: rows.groupBy(*EXPORT).agg(F.max("told").alias("told")).where("told = 0").select(*EXPORT)
        # equal rows have equal hashes
        hashed, x = both.withColumn("hash", F.xxhash64(*EXPORT)), F.col("hash") == F.col("x")
        shared = repeated(hashed, F.col("hash"))
        if shared is None:
            return once(both)
        return hashed.where("told = 0").join(shared, x, "left_anti").select(*EXPORT).unionByName(once(hashed.join(shared, x, "left_semi")))

    def take(self, rows: DataFrame, batch: int) -> None:
        cursor = self.cursor(batch)
        edge = None if cursor is None else cursor - timedelta(seconds=self.overlap)
        rows = rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        behind = 0 if edge is None else rows.where(F.col("created_at") < at(edge)).count()
        self.fresh(rows, edge, batch).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch}")
        told = self._told().where(F.col("batch") == batch)
        told.agg(F.max("created_at").alias("cursor"), F.lit(behind).cast("long").alias("behind")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cursors/batch={batch}")

    def drain(self, articles: DataFrame) -> int:
        """Takes all that the stream holds now; returns how many rows came behind the overlap."""
        last = self._notes().agg(F.max("batch")).first()[0] if exists(self.spark, f"{self.folder}/cursors") else None
        articles.writeStream.option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(self.take).start().awaitTermination()
        if not exists(self.spark, f"{self.folder}/cursors"):
            return 0
        return self._notes().where(F.col("batch") > (-1 if last is None else last)).agg(F.coalesce(F.sum("behind"), F.lit(0))).first()[0]

    def rows(self) -> DataFrame:
        """The newest copy of each id that was told, as the batch form has it."""
        told = self._told().drop("batch")
        several = repeated(told, F.col("external_id"))
        if several is None:
            return _newest(told)
        x = F.col("external_id").eqNullSafe(F.col("x"))
        return told.join(several, x, "left_anti").select("external_id", "created_at", "title_original", "url").unionByName(_newest(told.join(several, x, "left_semi")))

    def cursor(self, before: int | None = None) -> datetime | None:
        """The newest moment told by the batches (before ``before``)."""
        if not exists(self.spark, f"{self.folder}/cursors"):
            return None
        notes = self._notes() if before is None else self._notes().where(F.col("batch") < before)
        return notes.agg(F.max("cursor")).first()[0]
