"""Operator 1 as SQL for DuckDB: every window counted anew."""

from __future__ import annotations

from .secrets import ACCESS, ALLOW, ASSIGN, CLASSES, HEX, KINDS, RUN, SCALE, WINDOW, most


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(name: str, pattern: str) -> str:
    p = _quoted(pattern)
    return f"""{name} AS (
  SELECT doc_id, u.i, m[u.i] AS match,
    CAST(coalesce(list_sum([length(x) for x in p[1:u.i]]), 0) + coalesce(list_sum([length(x) for x in m[1:u.i - 1]]), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS p FROM d), unnest(range(1, len(m) + 1)) AS u(i)
)"""


def sql() -> str:
    kinds = "CASE " + " ".join(f"WHEN regexp_matches(match, {_quoted(shape)}) THEN {KINDS.index(name)}" for name, shape, _ in CLASSES) + " END"
    limits = "CASE kind " + " ".join(f"WHEN {KINDS.index(name)} THEN {most(bits)}" for name, _, bits in CLASSES) + " END"
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END"
    fits = lambda p: f"regexp_matches(match, {_quoted(p)})"
    allowed = " AND ".join("NOT (" + " AND ".join([*map(fits, every), *(f"NOT {fits(p)}" for p in none)]) + ")" for every, none in ALLOW)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_matches("a", ASSIGN)},
{_matches("k", ACCESS)},
{_matches("h", HEX)},
{_matches("r", RUN)},
base AS (
  SELECT doc_id, start, 0 AS kind, start + length(match) AS stop FROM a WHERE length(regexp_extract(match, {_quoted(ASSIGN)}, 2)) >= 8
  UNION ALL SELECT doc_id, start, 1, start + length(match) FROM k
  UNION ALL SELECT doc_id, start, 2, start + length(match) FROM h
), runs AS (
  SELECT doc_id, i, start, {kinds} AS kind, CASE WHEN {kinds} = {KINDS.index(CLASSES[0][0])} THEN lower(match) ELSE match END AS run
  FROM r WHERE regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND {allowed}
), windows AS (SELECT runs.*, w.pos FROM runs, unnest(range(0, length(run) - {WINDOW} + 1)) AS w(pos)),
letters AS (SELECT doc_id, i, start, kind, pos, substr(run, CAST(pos + c.j AS BIGINT), 1) AS letter, count(*) AS n FROM windows, unnest(range(1, {WINDOW + 1})) AS c(j) GROUP BY ALL),
sums AS (SELECT doc_id, i, start, kind, pos, sum(CAST(round(n * log2(n) * {SCALE}) AS BIGINT)) AS total FROM letters GROUP BY ALL),
hot AS (SELECT doc_id, start + min(pos) AS start, kind, start + max(pos) + {WINDOW} AS stop FROM sums WHERE total <= {limits} GROUP BY doc_id, i, sums.start, kind),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM hot),
listed AS (SELECT doc_id, kind, start, stop, {names} || ':' || start || ':' || stop AS span FROM everything)
SELECT d.doc_id, CAST(count(*) FILTER (kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 2) AS BIGINT) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind, stop), '') AS spans
FROM d LEFT JOIN listed ON listed.doc_id = d.doc_id GROUP BY d.doc_id
"""
