"""Operator 1: secrets in whole texts, in DataFrame functions only.

Three kinds are patterns. The method adds candidates by entropy: over every run of at least ``WINDOW`` characters that
secrets are written in, a window slides one character at a time; the count of the character that enters and of the one
that leaves are all that changes, and with them the window's Shannon entropy. Windows at or above the limit of the run's
character class make a span, from the first such window's start to the last one's end. Runs that the allow-list knows are
left out. Entropy is kept as a whole number, so that the order of additions cannot matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"

WINDOW = 20
#: Of a run that is all hexadecimal digits, all letters and digits, or more: the kind and the least bits a character.
CLASSES = (("entropy_hex", r"^[0-9A-Fa-f]+$", 2.8), ("entropy_alnum", r"^[0-9A-Za-z]+$", 3.75), ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
KINDS = ("assign", "access", "hex", *(name for name, _, _ in CLASSES))
#: A run is no secret if it matches all of the first patterns and none of the second: identifiers in dashed groups, marked
#: samples, and at least four dashed words. No group is repeated in them: each repeat would be a call deeper in the JVM.
ALLOW = (
    ((r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",), ()),
    ((r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)",), ()),
    ((r"^[a-z0-9][a-z0-9/_-]*[a-z0-9]$", r"[-_/][a-z0-9]+[-_/][a-z0-9]+[-_/]"), (r"[-_/]{2}",)),
)
#: Counts of a window, five bits each and twelve to a word, for the characters from + to z.
_BITS, _EACH, _FIRST = 5, 12, ord("+")
_WORDS = -(-(ord("z") - _FIRST + 1) // _EACH)
#: Long runs are scanned, and long texts cut, in parts of so many characters.
PART, PIECE = 4096, 1024
#: How many values are added up at once.
_TOTALS = 256
SCALE = 1_000_000


def term(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count else 0


def most(bits: float) -> int:
    """The largest sum of terms of a window whose entropy is at least ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _before(values: Column, add, kind: str = "int") -> Column:
    """For each of an array of values what ``add`` makes of 0 and all values before it.

    Blocks of values are folded first, then the blocks' results, then each block again from where it starts: appending in
    one fold over all values would copy the array once for each of them.
    """
    start = lambda at: F.struct(at.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda acc, v: F.struct(add(acc.at, v).cast(kind).alias("at"), F.array_append(acc.out, acc.at).alias("out"))
    fold = lambda block, at: F.aggregate(block, start(at), step)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / _TOTALS).cast("int")), lambda k: F.slice(values, k * _TOTALS + 1, _TOTALS))

    def joined(blocks: Column) -> Column:
        heads = fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast(kind), lambda acc, v: add(acc, v).cast(kind))), F.lit(0)).out
        return _let(heads, lambda heads: F.flatten(F.transform(blocks, lambda b, k: fold(b, F.get(heads, k)).out)))

    return _let(blocks, joined)


def _matches(text: Column, pattern: str, ahead: str = "") -> Column:
    """(start, stop, match) of all matches: what lies between them gives their places, in code points."""
    found = F.regexp_extract_all(text, F.lit(f"{ahead}({pattern})"), F.lit(1))

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, f"{ahead}{pattern}", -1), lambda between: F.length(between))
        return _let(gaps, lambda gaps: with_gaps(found, gaps))

    def with_gaps(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m))
        stops = lambda before: F.transform(found, lambda m, i: F.struct((F.get(before, i) + F.get(gaps, i)).alias("start"), (F.get(before, i) + F.get(gaps, i) + F.length(m)).alias("stop"), m.alias("match")))
        return _let(_let(steps, lambda steps: _before(steps, lambda at, v: at + v)), stops)

    none = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    return _let(found, lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m.stop.alias("stop")))


def _scan_part(part: Column, limit: Column) -> Column:
    """(first, last) of the windows of a part of a run whose sum of terms is at most ``limit``; nulls if there are none.

    A step adds one to the count of the character that enters, takes one from that of the character that leaves, and
    changes the sum by the terms of these two counts alone.
    """
    terms = F.array(*(F.lit(term(c)) for c in range(WINDOW + 1)))
    powers = F.array(*(F.lit(1 << (_BITS * k)).cast("long") for k in range(_EACH)))
    codes = F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.ascii(c) - _FIRST)

    def steps(codes: Column) -> Column:
        place = lambda code: F.struct((code / _EACH).cast("int").alias("word"), (code % _EACH * _BITS).alias("shift"), F.get(powers, code % _EACH).alias("one"))
        return F.transform(codes, lambda c, i: F.struct(place(c).alias("came"), F.when(i >= WINDOW, place(F.get(codes, i - WINDOW))).alias("left"), F.when(i >= WINDOW, c == F.get(codes, i - WINDOW)).otherwise(False).alias("same"), (i + 1).alias("i")))

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), _WORDS).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def slide(acc: Column, x: Column) -> Column:
        count = lambda at: F.call_function("shiftrightunsigned", F.get(acc.counts, at.word), at["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        change = lambda n, by: F.get(terms, n + by) - F.get(terms, n)
        total = acc["sum"] + F.when(x.same, 0).otherwise(_let(count(x.came), lambda n: change(n, 1)) + F.when(x.left.isNotNull(), _let(count(x.left), lambda n: change(n, -1))).otherwise(0))
        moved = F.transform(acc.counts, lambda n, j: n + F.when(j == x.came.word, x.came.one).otherwise(0) - F.when(j == x.left.word, x.left.one).otherwise(0))
        counts = F.when(x.same, acc.counts).otherwise(moved)
        return _let(total, lambda total: held(acc, x, total, counts))

    def held(acc: Column, x: Column, total: Column, counts: Column) -> Column:
        hot = (x.i >= WINDOW) & (total <= limit)
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(acc.first.isNull() & hot, x.i - WINDOW).otherwise(acc.first).alias("first"), F.when(hot, x.i).otherwise(acc["last"]).alias("last"))

    return F.aggregate(_let(codes, steps), zero, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(runs: Column, allow: tuple) -> Column:
    def secret(r: Column) -> Column:
        known = F.lit(False)
        for every, none in allow:
            fits = F.lit(True)
            for pattern in every:
                fits = fits & r.match.rlike(pattern)
            for pattern in none:
                fits = fits & ~r.match.rlike(pattern)
            known = known | fits
        return r.match.rlike("[0-9]") & r.match.rlike("[A-Za-z]") & ~known

    def scan(r: Column) -> Column:
        kind, limit = F.lit(KINDS.index(CLASSES[-1][0])), F.lit(most(CLASSES[-1][2]))
        for name, shape, bits in reversed(CLASSES[:-1]):
            kind = F.when(r.match.rlike(shape), KINDS.index(name)).otherwise(kind)
            limit = F.when(r.match.rlike(shape), most(bits)).otherwise(limit)
        whole = F.when(r.match.rlike(CLASSES[0][1]), F.lower(r.match)).otherwise(r.match)
        # a part goes on into the next one as far as the last window that starts in it
        cut = F.regexp_extract_all(whole, F.lit(f"(.{{1,{PART}}})"), F.lit(1))
        parts = _let(cut, lambda cut: F.transform(cut, lambda c, k: F.concat(c, F.coalesce(F.substring(F.get(cut, k + 1), 1, WINDOW - 1), F.lit("")))))
        ends = lambda limit: F.transform(parts, lambda p, k: _let(_scan_part(p, limit), lambda x: F.struct((x["first"] + k * PART).alias("first"), (x["last"] + k * PART).alias("last"))))
        span = lambda x: F.struct((r.start + F.array_min(F.transform(x, lambda e: e["first"]))).alias("start"), kind.alias("kind"), (r.start + F.array_max(F.transform(x, lambda e: e["last"]))).alias("stop"))
        return _let(_let(limit, ends), span)

    return F.filter(F.transform(F.filter(runs, secret), scan), lambda s: s.start.isNotNull())


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ",")


def with_secrets(docs: DataFrame, text: str = "text", allow: tuple = ALLOW) -> DataFrame:
    """``docs`` with columns base and found: arrays of (start, kind, stop), in order, of the patterns and of everything."""
    whole = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(_matches(whole, ASSIGN), lambda m: F.length(F.regexp_extract(m.match, ASSIGN, 2)) >= 8)
    base = F.concat(_spans(assign, "assign"), _spans(_matches(whole, ACCESS), "access"), _spans(_matches(whole, HEX, r"(?<![0-9a-f])"), "hex"))
    marked = docs.withColumns({"base": F.array_sort(base), "runs": _matches(whole, RUN, r"(?<![A-Za-z0-9+/_=-])")})
    return marked.withColumn("found", F.array_sort(F.concat("base", _entropy_spans(F.col("runs"), allow)))).drop("runs")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``docs`` needs doc_id and text; other columns are not read. A null or empty text, or one without secrets, has zero
    counts, the digest of an empty string and empty spans. Repeated rows give repeated results.
    """
    found = with_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs``, same columns, with every found span of text replaced by ``mark`` (overlapping spans by one).

    ``docs`` needs text; other columns, of any name, come back as they are. A null text stays null; repeated rows stay.
    """
    names = docs.columns
    inner = docs.select(F.struct(*(quoted(c) for c in names)).alias("row"), quoted("text").alias("text"))
    found = with_secrets(inner)

    def cut(pieces: Column, before: Column) -> Column:
        """What stands before each span and after the last one, taken from pieces of the text so that none is walked from its start."""

        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            inside = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            head = F.substring(F.get(pieces, first), a % PIECE + 1, F.when(first == last, b - a).otherwise(PIECE))
            return F.when(b <= a, "").when(first == last, head).otherwise(F.concat(head, inside, F.substring(F.get(pieces, last), F.lit(1), b - last * PIECE)))

        kept = F.transform(F.col("found"), lambda s, i: F.when(s.start >= F.get(before, i), F.concat(between(F.get(before, i), s.start), F.lit(mark))).otherwise(""))
        end = F.greatest(F.get(before, F.size(before) - 1), F.get(F.col("found"), F.size("found") - 1).stop)
        return F.concat(F.array_join(kept, ""), between(end, F.length("text")))

    stops = F.transform(F.col("found"), lambda s: s.stop)
    before = _let(stops, lambda stops: _before(stops, lambda at, v: F.greatest(at, v)))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"(?s)(.{{1,{PIECE}}})"), F.lit(1))
    whole = _let(pieces, lambda pieces: _let(before, lambda before: cut(pieces, before)))
    clean = F.when(F.size("found") > 0, whole).otherwise(F.col("text"))
    return found.select(*((clean if c == "text" else F.col("row").getField(c)).alias(c) for c in names))
