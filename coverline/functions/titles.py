"""Titles and texts: cleaning and judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions.columns import let
from coverline.functions.urls import title_from_link

#: Fixed values of the standard: entities that feeds carry most; numbered ones are decoded by rule.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "oacute": "ó", "aacute": "á", "iacute": "í", "euro": "€", "copy": "©"}


def decode_entities(text: Column, passes: int = 3) -> Column:
    """Named and numbered character references, also those that were escaped once or twice more; a text without ``&`` is left as it is."""

    def numbered(p: Column) -> Column:
        code = F.substring_index(p, ";", 1)
        number = F.when(code.rlike("^[xX]"), F.conv(F.substring(code, 2, 8), 16, 10)).otherwise(code).cast("int")
        char = let(number, lambda n: F.when(n < 128, F.chr(n)).when(n < 0x110000, _utf8(n)).otherwise(""))
        return F.coalesce(F.concat(char, F.substring(p, F.length(code) + 2, 1 << 30)), F.concat(F.lit("&#"), p))

    def once(t: Column) -> Column:
        pieces = F.split(t, r"&#(?=[xX]?[0-9a-fA-F]{1,6};)", -1)
        plain = let(pieces, lambda ps: F.array_join(F.concat(F.slice(ps, 1, 1), F.transform(F.slice(ps, 2, 1 << 30), numbered)), ""))
        for name, value in ENTITIES.items():
            plain = F.replace(plain, F.lit(f"&{name};"), F.lit(value))
        return F.when(F.contains(t, F.lit("&")), plain).otherwise(t)

    for _ in range(passes):
        text = let(text, once)
    return text


def _utf8(number: Column) -> Column:
    """The character of a code point from 128 on, by its UTF-8 bytes."""
    tail = lambda shift: F.lpad(F.hex(F.shiftright(number, shift).bitwiseAND(F.lit(63)) + 128), 2, "0")
    two = F.concat(F.hex(F.shiftright(number, 6) + 192), tail(0))
    three = F.concat(F.hex(F.shiftright(number, 12) + 224), tail(6), tail(0))
    four = F.concat(F.hex(F.shiftright(number, 18) + 240), tail(12), tail(6), tail(0))
    return F.decode(F.unhex(F.when(number < 0x800, two).when(number < 0x10000, three).otherwise(four)), "UTF-8")


def clean_text(text: Column, max_chars: int) -> Column:
    """No control characters, entities decoded, spaces collapsed, cut by code points; tags stay."""
    plain = F.regexp_replace(decode_entities(F.coalesce(text, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    plain = F.regexp_replace(plain, " ", " ")
    return F.substring(F.trim(F.regexp_replace(plain, r"[\s]+", " ")), 1, max_chars)


def display_source(source: Column) -> Column:
    """Spaces collapsed; cut at the first `` - `` if the word sitemap comes anywhere after it."""
    clean = F.trim(F.regexp_replace(source, r"\s+", " "))
    return F.regexp_replace(clean, r"(?i)^(.+?) - (?=.*\bsitemap\b).*$", "$1")


def source_key(source: Column) -> Column:
    return F.lower(display_source(source))


#: Shapes of titles that say nothing (file names, ids, section names).
LOW_SIGNAL = (
    r"(?i)^c[0-9]+\s+[0-9]+(\.html)?$", r"(?i)^art[- ][0-9]+(\.html)?$", r"(?i)^audio\s+[0-9]+(\.html)?$", r"(?i)^a[0-9]{6,}(\.html)?$", r"(?i)^story[0-9]{8}([-_ ][0-9]+)?(\.html)?$", r"^[0-9]{6,}$",
    r"(?i)^[a-f0-9]{32}$", r"(?i)^https?(://|%3a%2f%2f)", r"(?i)^[\w\s'’.-]{3,}\.(html|jpg|jpeg|png|gif|webp)$", r"(?i)^(news|latest|domestic|international|photo|video)$",
)


def assess_title(title: Column, url: Column, repair_attempted: Column | None = None) -> Column:
    """A struct of normalized, readable, quality, reason and repair_status; a title that says nothing may be read from the link."""
    tried = F.lit(False) if repair_attempted is None else repair_attempted
    pattern = "|".join(f"(?:{shape})" for shape in LOW_SIGNAL)

    def judge(x: Column) -> Column:
        normal, from_link = x["normal"], x["from_link"]
        reason = F.when(normal == "", "missing_title").when(x["low"] & (F.size(F.split(from_link, " ")) >= 3), "recovered_from_link").when(x["low"], "low_signal_title").otherwise("feed_title_ok")
        return let(reason, lambda r: F.struct(
            normal.alias("normalized"), F.when(r == "recovered_from_link", from_link).when(r == "feed_title_ok", normal).otherwise("").alias("readable"),
            F.when(r == "feed_title_ok", "ok").when(r == "recovered_from_link", "recovered").otherwise("suspect").alias("quality"), r.alias("reason"),
            F.when(r == "feed_title_ok", "not_needed").when(r == "recovered_from_link", "recovered").when(tried, "failed").otherwise("pending").alias("repair_status"),
        ))

    seen = let(clean_text(title, 500), lambda n: F.struct(n.alias("normal"), (n.rlike(pattern) | F.coalesce(n == url, F.lit(False))).alias("low"), title_from_link(url).alias("from_link")))
    return let(seen, judge)
