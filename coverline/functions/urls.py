"""Links: normal forms, identities and what a link says about its article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions.columns import let

#: Query parameters that never name an article; utm_* are dropped as well.
DROPPED = ("gclid", "fbclid", "ocid", "cmpid", "ref", "output")
#: The same for the newer form, which keeps the others and their order.
DROPPED_V1 = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _PARTS, k)


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; empty where there is none."""
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", ""), r":[0-9]*$", "")


def _params(query: Column, dropped: tuple[str, ...]) -> Column:
    """Name and value pairs that stay, in order, as name=value."""
    listed = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    return F.filter(listed, lambda p: ~name(p).startswith("utm_") & ~name(p).isin(*dropped))


def _unwrapped(link: Column) -> Column:
    """What a news search's click link leads to, else the link."""
    wrapped = F.regexp_extract(link, r"(?i)^https?://(?:[^/?#]*\.)?bing\.com/[^?#]*news/apiclick\.aspx[^#]*[?&]url=([^&#]+)", 1)
    return let(wrapped, lambda w: F.when(w != "", F.coalesce(F.try_url_decode(w), w)).otherwise(link))


def _sorted_link(clean: Column) -> Column:
    scheme = F.lower(_part(clean, 1))
    host = F.regexp_replace(F.regexp_replace(F.concat(scheme, F.lit("://"), F.lower(_part(clean, 2))), "^(https://.*):443$", "$1"), "^(http://.*):80$", "$1")
    path = let(F.regexp_replace(_part(clean, 3), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
    kept = F.transform(F.array_sort(_params(_part(clean, 4), DROPPED)), lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    query = let(F.array_join(kept, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(clean.rlike(_PARTS), F.concat(host, path, query)).otherwise(F.regexp_replace(clean, "/+$", ""))


def normalize_link(url: Column) -> Column:
    """One form for links to the same article: unwrapped, no fragment, tracking dropped, parameters sorted, host in lower case."""
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "(?i)&amp;", "&")
    return let(clean, lambda c: let(_unwrapped(c), lambda d: let(_unwrapped(d), _sorted_link)))


def article_url(url: Column) -> Column:
    """The newer form: parameter order and path case stay, only click ids go; the fragment goes."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    path = _part(clean, 3)
    kept = _params(_part(clean, 4), DROPPED_V1)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(clean.rlike(_PARTS), F.concat(F.lower(_part(clean, 1)), F.lit("://"), F.lower(_part(clean, 2)), F.when(path == "", "/").otherwise(path), query)).otherwise(clean)


def article_kind(url: Column) -> Column:
    """uncertain for home, section, tag and forum pages, else candidate."""
    path = F.lower(_part(F.trim(url), 3))
    vague = path.rlike(r"^/*$") | path.rlike(r"^/[^/]+/?$") & ~path.rlike("[0-9]") | path.rlike(r"^/(tag|tags|topic|topics|category|categories|section|author|forum|forums|search)(/|$)")
    return F.when(vague, "uncertain").otherwise("candidate")


def article_id(link: Column) -> Column:
    return F.sha2(normalize_link(link), 256)


def feed_stable_id(guid: Column, link: Column) -> Column:
    """An item's id within its feed: a link in normal form, or the text with spaces collapsed, under the link's host."""
    clean = F.regexp_replace(F.trim(F.coalesce(guid, F.lit(""))), "(?i)&amp;", "&")
    value = let(clean, lambda c: F.when(c.rlike("(?i)^https?://"), normalize_link(c)).otherwise(F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 512)))
    host = let(host_of(normalize_link(link)), lambda h: F.when(h == "", "").otherwise(F.concat(h, F.lit(":"))))
    return let(value, lambda v: F.when(v == "", "").otherwise(F.concat(F.lit("feed:"), host, v)))


def title_from_link(url: Column) -> Column:
    """Words of the last path segment that says something: no ending, no ids, first letter large."""
    segments = F.filter(F.split(_part(url, 3), "/"), lambda s: (s != "") & ~s.rlike(r"(?i)^(index|amp|news|article|articles|story|p)(\.[a-z]+)?$") & s.rlike("[A-Za-z]{2}"))
    last = F.when(F.size(segments) > 0, F.element_at(segments, -1)).otherwise("")
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", ""), r"[-_]+", " "), r"(^| )[0-9]{4,}(?= |$)", ""))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10000))


def date_in_link(url: Column) -> Column:
    """The first plausible year, month and day in a link, at midnight."""
    y, m, d = (F.regexp_extract(url, r"(?:^|[^0-9])((?:19|20)[0-9]{2})[-/_](0[1-9]|1[0-2])[-/_](0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", k) for k in (1, 2, 3))
    return F.when(y != "", F.to_date(F.concat_ws("-", y, m, d))).cast("timestamp_ntz")
