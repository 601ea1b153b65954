"""Registrable domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.functions.columns import let
from coverline.sources.rules import small


def parents(host: Column) -> Column:
    """The host and everything above it, longest first: a.b.c, b.c, c."""
    return let(F.split(F.lower(host), r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain) of distinct hosts: the longest public suffix of each, and one label more; hosts that are a suffix have none.

    ``suffixes`` has rules as in the public list: a name, ``*.name`` for all names one label below it, and ``!name`` for an exception
    to that, whose suffix starts a label later and which goes first. A host that no rule fits has its last label for a suffix.
    What a host asks the table for are its own parents, so no host meets every rule.
    """
    rules = small(suffixes.select(F.lower(F.trim("rule")).alias("key")).where("key <> ''").distinct())
    names = hosts.select(F.lower("host").alias("host")).where("host <> ''").distinct()
    at = names.select("host", F.size(F.split("host", r"\.")).alias("n"), F.posexplode(parents(F.col("host"))).alias("k", "name"))
    depth = F.col("n") - F.col("k")  # labels of the name
    below = F.regexp_replace("name", r"^[^.]+\.", "*.")
    keys = F.array(F.struct(F.col("name").alias("key"), depth.alias("labels"), F.lit(0).alias("first")), F.struct(below.alias("key"), depth.alias("labels"), F.lit(0).alias("first")), F.struct(F.concat(F.lit("!"), "name").alias("key"), (depth - 1).alias("labels"), F.lit(1).alias("first")))
    asked = at.select("host", "n", F.explode(keys).alias("x")).select("host", "n", "x.*")
    best = asked.join(rules, "key").groupBy("host").agg(F.max(F.struct("first", "labels")).alias("x"))
    size = F.coalesce(F.col("x.labels"), F.lit(1)) + 1
    labels = F.split("host", r"\.")
    return names.join(best, "host", "left").select("host", F.when(F.size(labels) >= size, F.array_join(F.slice(labels, F.size(labels) - size + 1, size), ".")).alias("domain"))
