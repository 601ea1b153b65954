"""Operator 12: exact duplicates by a persistent index of digests.

The index is a table of one row a digest, bucketed and sorted by it, in a folder that outlives the session. A batch is hashed
once; its digests are reduced to one row each and meet the index by a sort-merge anti-join, for which the index needs no
shuffle; what is left is appended. A batch that is added twice, or whose writing was cut short, changes nothing the second
time. Main path: Spark functions only.

A text that a third of all rows share is never one task's: rows are counted first by digest and one of ``SALTS`` shares, dealt
by doc_id, and get their answer back by digest and share, so no shuffle by digest alone carries rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, keep, scratch_path

#: Characters that do not count: space and 0x09 to 0x0D.
BLANK = " \t\n\x0b\x0c\r"
BUCKETS = 64
SALTS = 512
SCHEMA = "digest binary, keep_id long, keep_length int"


def digest(text: Column) -> Column:
    """SHA-256 of the text without its white space, as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANK, "").cast("binary"), 256))


class Index:
    """An index in ``folder``, made there if it is new. ``buckets`` counts only then; an index that grows past some
    hundred MB a bucket is best copied to one of more buckets by ``rebuilt``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        made = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/buckets")
        if made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made):
            buckets = spark.read.schema("buckets int").json(f"{self.folder}/buckets").first().buckets
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(f"{self.folder}/buckets")
        self.buckets = buckets
        self.name = f"coverline_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}/digests'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def missing(self, heads: DataFrame) -> DataFrame:
        """The rows of ``heads`` whose digest the index has not."""
        return heads.join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, heads: DataFrame) -> None:
        """Adds heads that ``missing`` left, a file a bucket."""
        fresh = self.missing(heads).select("digest", "keep_id", "keep_length").repartition(self.buckets, "digest")
        fresh.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", f"{self.folder}/digests").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def rebuilt(self, folder: str, buckets: int) -> Index:
        """A copy with other buckets, and one file in each."""
        copy = Index(self.spark, folder, buckets)
        copy.append(self.table())
        return copy

    def close(self) -> None:
        """Forget the table's name in this session; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _best() -> Column:
    """Orders rows of one text: most code points, then smallest doc_id, null ids last."""
    return F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"))


def deduplicate(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``; the texts that the index did not have are added.

    Texts are equal if they are when all white space is deleted; null counts as empty, and empty texts are equal to each
    other. A text that an earlier batch brought keeps that batch's document, and none of this batch stays. Of a new text the
    row with the most code points stays, then the smallest doc_id; a row without doc_id stays only if no row of that length
    has one. ``group_size`` counts this batch's rows of the text. Rows that agree in text, length and doc_id cannot be told
    apart and share their fate; so does a batch that is given again. An empty table gives no rows and adds nothing. Other
    columns are not read.
    """
    share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(SALTS)).cast("int")
    rows = keep(docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("length"), digest(F.col("text")).alias("digest"), share.alias("share")), "digests")
    shares = keep(rows.groupBy("digest", "share").agg(F.min(_best()).alias("best"), F.count("*").alias("n")), "shares")
    heads = keep(shares.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")).select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("keep_length"), "n"), "heads")
    index.append(heads)
    # the digest's document comes from the index, be it this batch's or an earlier one's
    answers = heads.select("digest", "n").join(index.table().hint("merge"), "digest")
    spread = shares.select("digest", "share").join(answers.hint("merge"), "digest")
    found = keep(rows.join(spread.hint("shuffle_merge"), ["digest", "share"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    ), "exact")
    drop(rows, shares, heads)
    return found


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``deduplicate`` against an index of its own in the shared folder."""
    index = Index(docs.sparkSession, scratch_path(docs.sparkSession, "index"))
    found = deduplicate(docs, index)
    index.close()
    return found


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS kept, text_sha256
FROM d
"""
