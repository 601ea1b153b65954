"""Dates as feeds write them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions.columns import at, let

#: Minutes east of UTC of zone abbreviations.
ZONES = {"UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "BST": 60, "MSK": 180, "JST": 540, "IST": 330}


def parse_loose_date(text: Column) -> Column:
    """A UTC time from epoch seconds or milliseconds, a bare date (noon), ISO or RFC 822 text, or text with a zone's name."""
    return let(F.trim(text), _parsed)


def _parsed(raw: Column) -> Column:
    number = F.when(raw.rlike(r"^-?[0-9]{9,14}$"), raw.cast("long"))
    epoch = F.timestamp_millis(F.when(F.abs(number) < 100_000_000_000, number * 1000).otherwise(number))
    day = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(F.concat(raw, F.lit("T12:00:00Z"))))
    iso = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), F.try_to_timestamp(raw))
    abbreviation = F.regexp_extract(raw, r"\s([A-Z]{2,5})$", 1)
    minutes = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv)), abbreviation), F.lit(0))
    body = F.regexp_replace(F.regexp_replace(raw, r"\s[A-Z]{2,5}$", ""), r"^[A-Za-z]{3},\s*", "")
    offset = F.regexp_extract(body, r"\s([+-][0-9]{4})$", 1)
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    shift = F.when(offset != "", sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int"))).otherwise(minutes)
    local = F.try_to_timestamp(F.regexp_replace(body, r"\s[+-][0-9]{4}$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    rfc = F.timestamp_micros(F.unix_micros(local) - shift.cast("long") * 60_000_000)
    zone = F.regexp_extract(raw, r"\s([A-Za-z_]+/[A-Za-z0-9_+-]+)$", 1)
    named = F.when(zone != "", F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(raw, r"\s[A-Za-z_]+/[A-Za-z0-9_+-]+$", "")), F.when(zone != "", zone).otherwise("UTC")))
    return F.coalesce(epoch, day, named, iso, rfc)


def relative_age(text: Column, as_of: datetime) -> Column:
    """The time that "3 hours ago" and the like mean."""
    n = F.regexp_extract(text, r"(?i)\b([0-9]+)\s*(minute|min|hour|day|week)s?\s+ago\b", 1).cast("int")
    unit = F.lower(F.regexp_extract(text, r"(?i)\b([0-9]+)\s*(minute|min|hour|day|week)s?\s+ago\b", 2))
    minutes = n * F.when(unit.startswith("min"), 1).when(unit == "hour", 60).when(unit == "day", 1440).otherwise(10080)
    return F.when(n.isNotNull(), (at(as_of).cast("timestamp").cast("long") - minutes * 60).cast("timestamp")).cast("timestamp_ntz")
