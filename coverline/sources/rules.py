"""Rule tables from files, under a schema and a bound on their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A rule table of at most so many rows may be sent to every task.
MOST_RULES = 100_000
SCHEMAS = {
    "keywords": "priority int, tier string, keyword string, section string",
    "categories": "priority int, kind string, pattern string, section string",
    "topics": "section string, label string, priority int, pattern string",
    "hints": "priority int, part string, section string",
    "places": "priority int, keyword string, name string, country string, lat double, lon double",
    "aliases": "priority int, keyword string, country string",
    "countries": "country string, lat double, lon double",
    "source_hints": "source_part string, segment string, country string",
    "publishers": "rule_no int, kind string, pattern string, countries string, publisher string",
    "foreign": "rule_no int, market string, pattern string, corporate_country string",
    "suffixes": "rule string",
    "deny": "host_suffix string, source_part string, path_pattern string",
}


def read_rules(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A rule table of a kind from CSV files with a header; a row that does not fit its schema is an error."""
    rows = spark.read.schema(SCHEMAS[kind]).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
    return rows.withColumn("countries", F.split("countries", ";")) if kind == "publishers" else rows


def small(rules: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """``rules`` marked for broadcast if they are few enough; else as they are, for Spark to choose the join."""
    return F.broadcast(rules) if rules.limit(most + 1).count() <= most else rules
