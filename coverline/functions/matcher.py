"""Many keywords or patterns against texts at once.

An automaton finds in one pass over a text which of many literals it holds. Keywords are literals themselves; a pattern is
looked at only where one of the literals that each of its matches must hold is there. Texts travel as Arrow batches; what a task
holds is one automaton.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverline.sources.rules import MOST_RULES

#: Patterns without any literal are tried on every text, so only a few may be so.
MOST_OPEN = 64


@functools.lru_cache(maxsize=8)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for k, literal in enumerate(literals):
        made.add_word(literal, k)
    made.make_automaton()
    return made


def finder(literals: list[str]) -> Callable[[Column], Column]:
    """A column function: which of ``literals`` a text holds, each once, in their order; none for a null text."""
    kept = tuple(sorted({x for x in literals if x}))

    @F.arrow_udf("array<string>")
    def held(texts: pa.Array) -> pa.Array:
        if not kept:
            return pa.array([[]] * len(texts), pa.list_(pa.string()))
        automaton = _automaton(kept)
        return pa.array([[kept[k] for k in sorted({k for _, k in automaton.iter(t.as_py())})] if t.is_valid else [] for t in texts], pa.list_(pa.string()))

    return held


def first_found(literals: list[str]) -> Callable[[Column], Column]:
    """A column function: the place in ``literals`` of the first that a text holds; null for none and for a null text."""
    places: dict[str, int] = {}
    for k, literal in enumerate(literals):
        if literal:
            places.setdefault(literal, k)
    kept, numbers = tuple(places), tuple(places.values())

    @F.arrow_udf("int")
    def first(texts: pa.Array) -> pa.Array:
        if not kept:
            return pa.nulls(len(texts), pa.int32())
        automaton = _automaton(kept)
        found = (min((k for _, k in automaton.iter(t.as_py())), default=None) if t.is_valid else None for t in texts)
        return pa.array([None if k is None else numbers[k] for k in found], pa.int32())

    return first


def _best(options: list[frozenset[str] | None]) -> frozenset[str] | None:
    """Of several sets, each of which holds a literal of every match, the one whose shortest literal is longest."""
    known = [x for x in options if x]
    return max(known, key=lambda x: (min(map(len, x)), -len(x), sorted(x)), default=None)


def required(pattern: str) -> frozenset[str] | None:
    """Literals in lower case of which every match of the pattern holds one; None where no such set is seen."""
    from re import _constants as kinds
    from re import _parser as parser

    def of(items) -> frozenset[str] | None:
        found, run = [], ""
        for kind, value in items:
            if kind is kinds.LITERAL:
                run += chr(value).lower()
                continue
            found.append(frozenset([run]) if run else None)
            run = ""
            if kind is kinds.SUBPATTERN:
                found.append(of(value[3]))
            elif kind is kinds.BRANCH:
                each = [of(x) for x in value[1]]
                found.append(frozenset().union(*each) if all(each) else None)
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
            elif kind is kinds.ATOMIC_GROUP:
                found.append(of(value))
        return _best([*found, frozenset([run]) if run else None])

    try:
        return of(parser.parse(pattern))
    except re.error:  # a form that only Java's patterns have
        return None


def pattern_matches(rows: DataFrame, text: Column, rules: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each row of ``rows`` beside each of ``rules`` (pattern and other columns) that its text matches anywhere, in any case.

    Columns of ``on`` must agree as well. Patterns are Java's; a null text matches none. No row meets a rule but those
    whose literals it holds, and the few patterns that have none.
    """
    spark = rows.sparkSession
    patterns = sorted(r.pattern for r in rules.where("pattern is not null").select("pattern").distinct().limit(MOST_RULES + 1).collect())
    if len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} patterns")
    needs = [required(p) for p in patterns]
    free = [k for k, x in enumerate(needs) if x is None]
    if len(free) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} patterns without a literal: {[patterns[k] for k in free[:5]]} ...")
    literals = tuple(sorted({x for need in needs if need for x in need}))
    by = [[k for k, need in enumerate(needs) if need and x in need] for x in literals]

    @F.arrow_udf("array<int>")
    def candidates(texts: pa.Array) -> pa.Array:
        automaton = _automaton(literals) if literals else None
        out = []
        for t in texts:
            held = {k for _, k in automaton.iter(t.as_py().lower())} if automaton and t.is_valid else ()
            out.append(sorted({p for k in held for p in by[k]} | set(free)) if t.is_valid else [])
        return pa.array(out, pa.list_(pa.int32()))

    numbered = F.broadcast(spark.createDataFrame([(k, p) for k, p in enumerate(patterns)], "number int, pattern string").join(rules, "pattern"))  # at most MOST_RULES patterns
    tried = rows.withColumn("__text", text).withColumn("number", F.explode(candidates("__text"))).join(numbered, ["number", *(on or [])])
    return tried.where(F.expr("rlike(__text, concat('(?iu)', pattern))")).drop("__text", "number")
