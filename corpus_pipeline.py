"""The corpus pipeline: five stages, each written and read again before the next.

Every stage takes documents with doc_id and text and any other columns, of any name, which come through as they are; all but
the last return the same columns. An empty table stays empty. What each does with nulls, empty texts and repeated rows is
in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coverline.llm import langid, minhash, packing, quality, secrets
from coverline.llm.shared import documents, keep, quoted
from coverline.plans.ship import ship

#: A document is kept if its language is known and at least this likely, and if its quality is not this unlikely. The
#: second is lower than the operator's own limit of a good document: what it finds doubtful stays, likely bad goes.
LANGUAGE_AT_LEAST = 0.3
QUALITY_AT_LEAST = 0.5


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that their names meet none of ours."""
    return F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias("row")


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null texts and texts without letters have none and go; repeated rows stay."""
    ship(spark)
    found = docs.select(_whole(docs), langid.language(langid.learn(docs)).alias("found"))
    return _columns(found.where((F.col("found.lang_pred") != langid.UNKNOWN) & (F.col("found.score") >= LANGUAGE_AT_LEAST)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than not. A null text is scored as an empty one; repeated rows share their fate."""
    ship(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(docs.select(_whole(docs), quality.score(model).alias("score")).where(F.col("score") >= QUALITY_AT_LEAST), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, of repeated rows any one.

    Rows are told apart by a number of their own, so repeated, shared and null doc_ids do no harm. Texts that are null,
    empty or without words are alike to nothing and stay.
    """
    ship(spark)
    rows = keep(docs.select(F.monotonically_increasing_id().alias("number"), _whole(docs)), "numbered")
    groups = minhash.near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row").getField("text").alias("text")))
    ids = rows.select("number", F.col("row").getField("doc_id").alias("doc_id"))
    named = groups.select(F.col("doc_id").alias("number"), "component_id").join(ids, "number")
    kept = named.groupBy("component_id").agg(F.min_by("number", F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("number"))
    return _columns(rows.join(kept, "number", "left_semi"), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars is that of the new text where it was that of the old. A null text stays null."""
    ship(spark)
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return clean.select(*(size.alias(c) if c == "n_chars" else quoted(c).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences. A null or empty text is the end token alone; repeated rows are packed as often."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("packing", packed)]
#: Two stages are learned models and one searches packings; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
