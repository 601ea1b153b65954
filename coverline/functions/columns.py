"""Small column helpers that several jobs share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sections in their order.
SECTIONS = ("world", "politics", "conflicts", "business", "tech", "sports", "health", "entertainment", "lifestyle", "arts", "science", "climate", "others")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, with ``x`` worked out once however often it is used."""
    return F.get(F.transform(F.array(x), body), 0)


def present(x: str | Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(x if isinstance(x, Column) else F.col(x)), F.lit(""))


def at(moment: datetime) -> Column:
    """A time without zone, as the logs hold."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def since(column: str | Column, as_of: datetime, **ago: float) -> Column:
    return (column if isinstance(column, Column) else F.col(column)) >= at(as_of - timedelta(**ago))


def within(column: str | Column, start: datetime, end: datetime) -> Column:
    """In [start, end)."""
    c = column if isinstance(column, Column) else F.col(column)
    return (c >= at(start)) & (c < at(end))


def ratio(part: Column, whole: Column, scale: int) -> Column:
    """Half-up rounded ``scale * part / whole`` in whole numbers; 0 where there is no whole."""
    return F.when(whole > 0, F.floor((2 * part * scale + whole) / (2 * whole))).otherwise(F.lit(0)).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 100)


def basis_points(part: Column, whole: Column) -> Column:
    return ratio(part, whole, 10000)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


def section_rank(section: Column) -> Column:
    """Place in the fixed order; unknown sections come last."""
    place = F.array_position(F.array(*(F.lit(s) for s in SECTIONS)), section)
    return F.when(place > 0, place).otherwise(len(SECTIONS) + 1)


#: Shapes of titles that reports leave out, then those that single sources use for their sections.
LOW_SIGNAL_TITLES = (
    r"^(c[0-9]+\s+[0-9]+(\.html)?|art[- ]?[0-9]+(\.html)?|story[0-9]{8}([-_ ]?[0-9]+)?(\.html)?|[0-9]{6,}|news|latest|domestic|international|photo|video)$",
    r"^[0-9a-f]{32}$",
    r"^cision[a-z0-9]+$",
    r"^catalog(\.aspx)?(\?.+)?$",
)
LOW_SIGNAL_BY_SOURCE = (
    ("oricon", r"^(full|news|anime|comic|voiceactor)$"),
    ("abema times", r"^(full|news|anime)$"),
    ("parapolitika", r"^[a-z0-9_-]{4,180}$"),
)


def low_signal_title(title: Column, url: Column, source: Column, quality: Column) -> Column:
    """Titles that reports leave out: suspect ones, bare links, file or id-like names, and names some sources use for sections."""
    t = F.coalesce(present(title), F.lit(""))
    tests = [F.coalesce(present(quality), F.lit("ok")) == "suspect", t == F.coalesce(url, F.lit("")), t.rlike("(?i)^http")]
    tests += [t.rlike(f"(?i){shape}") for shape in LOW_SIGNAL_TITLES]
    tests += [source.rlike(f"(?i){name}") & t.rlike(f"(?i){shape}") for name, shape in LOW_SIGNAL_BY_SOURCE]
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out
