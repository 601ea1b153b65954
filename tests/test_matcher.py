"""Keywords, patterns and rules of publishers against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from coverline.functions import matcher
from coverline.functions.matcher import finder, pattern_matches, required
from coverline.operators import classify
from coverline.sources import rules as rule_files
from coverline.sources.rules import SCHEMAS, read_rules

PATTERNS = (
    "sanctions?|tariffs?", r"\bring\b", "diplomac|diplomat", r"icc\b|icj\b", "(colou?r|hue)s?", "a(b|c)d", "x+y", "(ab){2,}", "z*", "[0-9]{3}", "q?uu", "^start", "end$", "в мире|мир\\b", "国際|国际", "a.c", "(?:foo|ba[rz])qux", "no such thing", "(alpha|)", "tax (reform|cut)",
)


def test_required_literals_are_in_every_match():
    rng = random.Random(1)
    pieces = ["sanction", "tariff", "ring", "diplomac", "icc", "icj ", "color", "colour", "hue", "abd", "acd", "xxy", "abab", "z", "123", "quu", "uu", "start", "end", "мир", "в мире", "国際", "abc", "fooqux", "barqux", " ", "x", "alpha", "tax cut", "y"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(3000)]
    for p in PATTERNS:
        need = required(p)
        for t in texts:
            if need is not None and re.search(p, t):
                assert any(x in t.lower() for x in need), (p, t)
    assert required("sanctions?|tariffs?") == {"sanction", "tariff"} and required("z*") is None and required("[0-9]{3}") is None and required("(alpha|)") is None
    assert required("a++b(?") is None  # not a pattern that is understood here: tried on every text


def test_patterns_meet_the_texts_that_match(spark):
    rng = random.Random(2)
    words = "sanctions tariff Ring rings DIPLOMACY icc iccx colours hue abd xxy ababab 123 start end мир 国際 abc fooqux bazqux tax reform cut no such".split()
    texts = [(i, f"s{i % 2}", " ".join(rng.choice(words) for _ in range(rng.randrange(7)))) for i in range(400)] + [(900, "s0", None), (901, "s1", ""), (902, "s0", "ring " * 20000)]
    rules = [(k, f"s{k % 2}", p) for k, p in enumerate(PATTERNS)] + [(77, "s0", None)]
    rows, table = spark.createDataFrame(texts, "id int, side string, text string"), spark.createDataFrame(rules, "rule int, side string, pattern string")
    for on in ([], ["side"]):
        got = sorted(map(tuple, pattern_matches(rows, F.col("text"), table if on else table.drop("side"), on).select("id", "rule").collect()))
        want = sorted((i, k) for i, s, t in texts for k, z, p in rules if t is not None and p and (not on or s == z) and re.search(p, t, re.I))
        assert got == want
    assert pattern_matches(rows.limit(0), F.col("text"), table.drop("side")).collect() == [] and pattern_matches(rows, F.col("text"), table.drop("side").limit(0)).collect() == []


def test_too_many_open_patterns_are_an_error(spark):
    table = spark.createDataFrame([(f"[0-9]{{{k}}}",) for k in range(1, 70)], "pattern string")
    with pytest.raises(ValueError, match="without a literal"):
        pattern_matches(spark.createDataFrame([("1",)], "text string"), F.col("text"), table)


def test_literals_are_found_once_each(spark):
    rows = spark.createDataFrame([(1, "abcabc"), (2, None), (3, ""), (4, "bca")], "id int, text string")
    found = {r.id: r.x for r in rows.select("id", finder(["abc", "bc", "ca", "zz", ""])(F.col("text")).alias("x")).collect()}
    assert found == {1: ["abc", "bc", "ca"], 2: [], 3: [], 4: ["bc", "ca"]}


def test_keywords_are_whole_words_and_parts_of_unspaced_scripts(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a new york minute"), (2, "new-york"), (3, "newyork"), (4, "経済政策"), (5, None), (6, "York new"), (7, "new  york new york")], "id int, text string")
    table = spark.createDataFrame([(1, "high", "new york", "world"), (2, "medium", "york", "arts"), (3, "high", "政策", "politics"), (4, "high", "...", "none")], SCHEMAS["keywords"])
    want = [(1, "arts"), (1, "world"), (2, "arts"), (2, "world"), (4, "politics"), (6, "arts"), (7, "arts"), (7, "world")]
    found = lambda: sorted(map(tuple, classify.matches(rows, "id", F.lower("text"), table).select("id", "section").collect()))
    assert found() == want
    monkeypatch.setattr(classify, "MOST_RULES", 1)  # more rules than one task may hold: by join, with the same result
    assert found() == want


def test_patterns_come_from_files_as_they_are(spark, tmp_path):
    table = spark.createDataFrame([("world", "a, b", 1, r'\bsaid "no"|x\d+\b')], SCHEMAS["topics"])
    path = str(tmp_path / "topics")
    table.write.option("header", True).option("escape", '"').csv(path)
    assert read_rules(spark, path, "topics").collect() == table.collect()


def test_publishers_by_kind(spark):
    rows = spark.createDataFrame([("Alpha", "A"), (" alpha ", "B"), ("Alphabet News", "A"), ("The Beta Times", "A"), ("The Beta Times", "B"), ("Gamma", None)], "source string, country string")
    table = spark.createDataFrame([(3, "exact", "alpha", None, "One"), (2, "prefix", "alphab", None, "Two"), (1, "contains", "beta", ["A"], "Three"), (9, "contains", "a", ["B"], "Four")], "rule_no int, kind string, pattern string, countries array<string>, publisher string")
    got = {(r.source, r.country): (r.publisher, r.matched_by) for r in classify.resolve_publisher(rows, table).collect()}
    assert got[("Alpha", "A")] == ("One", "exact") and got[("Alphabet News", "A")] == ("Two", "prefix") and got[("The Beta Times", "A")] == ("Three", "contains") and got[("The Beta Times", "B")] == ("Four", "contains")
    assert got[(" alpha ", "B")] == ("One", "exact")
    assert (rule_files.MOST_RULES, matcher.MOST_OPEN) == (100_000, 64)
