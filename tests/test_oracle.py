"""Every news query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from coverline.plans import news

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries whose views hold rows that the smallest tables lack: newest checks without a status, days without checks, rare kinds.
RARE = ("s4_export_catalog", "h4_failure_watchlist", "h8_follow_ups", "h13_sitemap_policy", "h14_recovery_plan", "a12_source_detail", "a24_taxonomy_audit", "a30_failure_reasons", "l3_activity_periods", "p5_page_categories")
LARGER = "/root/testdata/sf0.01"


def opened(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def duck(small):
    return opened(small)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def held_against(spark, duck, folder, name):
    df = news.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in news.SQL:
        assert got
        return
    found = duck.sql(news.SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(news.QUERIES))
def test_query(spark, duck, small, name):
    held_against(spark, duck, small, name)


@pytest.mark.parametrize("name", RARE)
def test_query_on_rare_rows(spark, name):
    held_against(spark, opened(LARGER), LARGER, name)
