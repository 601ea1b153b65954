"""Operator 2: URL rules as one bit-parallel automaton.

Every rule becomes a glob over the canonical URL; all globs are packed into rows of 64-bit words, a bit for each place in
each glob. One step of the automaton takes a byte of every URL at once: shift, mask by the byte, and keep the places where
a star stands. What remains set at a URL's end tells every rule that matches it.

Canonical URL: ``.host#path?query`` with the host in lower case; the fragment is dropped. A host holds no ``/``, ``?`` or
``#``, a path no ``?`` or ``#``, so the one ``#`` parts host and path, and a rule for a host and path is exactly the glob
``*.host#path*``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import buffers


@dataclass(frozen=True)
class Rule:
    """``host`` holds for the host and its subdomains, ``path`` is a prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}#{self.path}*"


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
#: For URLs that no rule fits: globs (``*`` any run, ``?`` any byte) over the canonical URL that block; all else is allowed.
BLOCKED = ("*spam*#*", "*pills*#*", "*casino*#*", "*.tracker.*#*", "*#*.exe", "*#*sessionid=*")


class Automaton:
    def __init__(self, globs: list[str]):
        steps: list[list[tuple[int | None, bool]]] = []
        for glob in globs:
            places: list[tuple[int | None, bool]] = [(None, False)]
            for c in glob.encode():
                if c == ord("*"):
                    places[-1] = (places[-1][0], True)
                else:
                    places.append((-1 if c == ord("?") else c, False))
            steps.append(places)
        total = sum(map(len, steps))
        self.n_words = max(1, -(-total // 64))
        self.masks = np.zeros((256, self.n_words), np.uint64)
        self.start, self.loop = np.zeros(self.n_words, np.uint64), np.zeros(self.n_words, np.uint64)
        self.ends = []
        at = 0
        for places in steps:
            for k, (c, star) in enumerate(places):
                word, bit = (at + k) // 64, np.uint64(1 << (at + k) % 64)
                if k == 0:
                    self.start[word] |= bit
                elif c == -1:
                    self.masks[:, word] |= bit
                else:
                    self.masks[c, word] |= bit
                if star:
                    self.loop[word] |= bit
            at += len(places)
            self.ends.append(((at - 1) // 64, np.uint64(1 << (at - 1) % 64)))

    def matches(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(rows, globs): which globs match each whole row."""
        order = np.argsort(starts - ends, kind="stable")
        size = (ends - starts)[order]
        state = np.repeat(self.start[None, :], len(order), axis=0)
        first = starts[order]
        alive = len(order)
        for j in range(int(size[0]) if len(size) else 0):
            alive = int(np.searchsorted(-size[:alive], -j, side="left"))
            now = state[:alive]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.masks[raw[first[:alive] + j]]
            moved |= now & self.loop
            state[:alive] = moved
        out = np.empty((len(order), len(self.ends)), bool)
        out[order] = np.stack([(state[:, word] & bit) != 0 for word, bit in self.ends], axis=1) if self.ends else np.empty((len(order), 0), bool)
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def judged(canonical: Column, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """A struct of rule and verdict: the longest rule that fits, else the globs' verdict. Of equally long rules the first holds."""
    automaton = Automaton([r.glob for r in rules] + list(blocked))
    ranked = sorted(range(len(rules)), key=lambda k: len(rules[k].name))
    ranked = sorted(ranked, key=lambda k: (len(rules[k].name), -k))

    @F.arrow_udf("struct<rule: string, verdict: string>")
    def judge(urls: pa.Array) -> pa.Array:
        found = automaton.matches(*buffers(urls))
        best = np.full(len(found), -1)
        for k in ranked:
            best[found[:, k]] = k
        bad = found[:, len(rules) :].any(axis=1) if blocked else np.zeros(len(found), bool)
        rule = [rules[k].name if k >= 0 else None for k in best.tolist()]
        verdict = [rules[k].verdict if k >= 0 else ("block" if b else "allow") for k, b in zip(best.tolist(), bad.tolist())]
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    return judge(canonical)


def judge_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``pages`` needs page_id and url; other columns are not read. A null or empty url, or one without ``://``, has an empty
    host and path, fits no host rule and is judged by the globs over ``.#``. Repeated rows give repeated results.
    """
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), query_of(F.col("url")).alias("query"))
    found = split.withColumn("found", judged(F.concat(F.lit("."), "host", F.lit("#"), "path", "query"), rules, blocked))
    return found.select("page_id", "host", "path", "found.rule", "found.verdict")


def sql(rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> str:
    """The same judgement in SQL: one comparison for each rule and glob."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ranked = sorted(rules, key=lambda r: -len(r.name))
    like = lambda g: "canonical LIKE '" + g.replace("_", "^_").replace("%", "^%").replace("*", "%").replace("?", "_") + "' ESCAPE '^'"
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, coalesce(regexp_extract(url, '^.*?://[^?#]*(\\?[^#]*)', 1), '') AS query FROM r),
c AS (SELECT *, '.' || host || '#' || path || query AS canonical FROM p)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ranked)} END AS rule,
  CASE {" ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ranked)} {" ".join(f"WHEN {like(g)} THEN 'block'" for g in blocked)} ELSE 'allow' END AS verdict
FROM c
"""
