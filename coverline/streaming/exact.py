"""Exact hourly benchmarks from a stream of articles (ST6): each batch recomputes the days it changes, rows that come late included."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from coverline.functions.columns import at
from coverline.operators.benchmark import benchmark_hours, days_of, write_snapshots
from coverline.sources.kept import exists, keep

VERSION = "v1"


class Snapshots:
    """In ``folder``: the articles by batch, the benchmark of every full hour by day, and a note on each batch.

    A batch writes its articles under its own number, so a repeat replaces them; the days that its rows count in are then
    recomputed from all articles up to it and replace their slices, which a repeat does again to the same end.
    ``late`` is how far behind the newest row of earlier batches a row may be and still count as in time.
    """

    def __init__(self, spark: SparkSession, folder: str, feeds: DataFrame, late: timedelta = timedelta(hours=1)):
        self.spark, self.folder, self.feeds, self.late = spark, folder.rstrip("/"), feeds, late

    def benchmarks(self) -> DataFrame:
        """The benchmark as of the last batch: bucket, country and the counts of A2."""
        return self.spark.read.parquet(f"{self.folder}/benchmarks").drop("bucket_key", "metric_version")

    def notes(self) -> DataFrame:
        """Of each batch its rows, how many of them came behind the lateness that live counts allow, and its newest moment."""
        return self.spark.read.schema("n long, behind long, newest timestamp_ntz, batch int").parquet(f"{self.folder}/notes")

    def _newest(self, batch: int) -> datetime | None:
        if not exists(self.spark, f"{self.folder}/notes"):
            return None
        return self.notes().where(F.col("batch") < batch).agg(F.max("newest")).first()[0]

    def take(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/articles/batch={batch}")
        own = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/articles/batch={batch}")
        newest = self._newest(batch)
        behind = F.lit(False) if newest is None else F.col("created_at") < at(newest - self.late)
        note = own.agg(F.count("*").alias("n"), F.count_if(behind).alias("behind"), F.max("created_at").alias("newest"))
        days = keep(days_of(own), "days")
        first, last = days.agg(F.min("day"), F.max("day")).first()
        if first is not None:
            # rows of other days are left to the scan's filters; what counts in a day is at most a day older than it
            edges = [at(datetime.combine(first, datetime.min.time()) - timedelta(days=1)), at(datetime.combine(last, datetime.min.time()) + timedelta(days=1))]
            near = lambda c: (F.col(c) >= edges[0]) & (F.col(c) < edges[1])
            table = self.spark.read.schema(StructType([*rows.schema.fields, StructField("batch", IntegerType())])).option("basePath", f"{self.folder}/articles").parquet(f"{self.folder}/articles")
            table = table.where((F.col("batch") <= batch) & (near("created_at") | near("publication_datetime"))).drop("batch")
            write_snapshots(benchmark_hours(table, self.feeds, days).withColumn("bucket_key", F.date_format("bucket", "yyyy-MM-dd")).repartition("bucket_key"), f"{self.folder}/benchmarks", VERSION)
        note.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/notes/batch={batch}")


def snapshots(articles: DataFrame, to: Snapshots, checkpoint: str) -> None:
    """Drains a stream of articles into exact snapshots; a run that was cut short goes on where it was."""
    articles.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(to.take).start().awaitTermination()
