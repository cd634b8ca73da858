"""The key of a written type in plain SQL (DuckDB), as a check on ``functions.typekeys``: tokens as rows, depth as a window."""

from __future__ import annotations

from orrery.functions.typekeys import PRIMITIVE_WORDS, QUALIFIERS

NAME = """CASE WHEN regexp_matches(coalesce(stored_fully_qualified_name, ''), '[^\\s\\p{Z}]') THEN stored_fully_qualified_name
 WHEN NOT regexp_matches(coalesce(base_name, ''), '[^\\s\\p{Z}]') THEN NULL
 WHEN regexp_matches(coalesce(namespace, ''), '[^\\s\\p{Z}]') THEN namespace || '::' || base_name ELSE base_name END"""


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def keys(strings: str) -> str:
    """CTEs; the last, ``k``, has s, full_key and base_key for each s of the query ``strings`` that is neither null nor blank."""
    prim, quals = _list(PRIMITIVE_WORDS), _list(QUALIFIERS)
    return f"""
strings AS (SELECT DISTINCT s FROM ({strings}) WHERE s IS NOT NULL AND regexp_matches(s, '[^\\s\\p{{Z}}]')),
lists AS (SELECT s, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[*&<>\\[\\]()]') AS l FROM strings),
toks AS (SELECT s, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM lists),
deep AS (SELECT *, sum(CASE WHEN t IN ('<', '(') THEN 1 WHEN t IN ('>', ')') THEN -1 ELSE 0 END) OVER (PARTITION BY s ORDER BY i)
  - CASE WHEN t IN ('<', '(') THEN 1 WHEN t IN ('>', ')') THEN -1 ELSE 0 END AS d FROM toks),
marked AS (SELECT *, coalesce(max(CASE WHEN d = 0 AND t IN ('*', '&', '[', '(') THEN 1 ELSE 0 END)
    OVER (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after_mark,
  sum(CASE WHEN d = 0 AND t = '[' THEN 1 WHEN d = 0 AND t = ']' THEN -1 ELSE 0 END) OVER (PARTITION BY s ORDER BY i) AS dim FROM deep),
k AS (SELECT l.s,
  coalesce(string_agg(t, ' ' ORDER BY t) FILTER (d = 0 AND after_mark = 0 AND t IN ({quals}, {prim})), '') || '|' ||
  coalesce(string_agg(t, '' ORDER BY i) FILTER (NOT (d = 0 AND after_mark = 0 AND t IN ({quals}, {prim}))), '') AS full_key,
  coalesce(string_agg(t, ' ' ORDER BY t) FILTER (d = 0 AND dim = 0 AND t IN ({prim})), '') || '|' ||
  coalesce(string_agg(t, '' ORDER BY i) FILTER (NOT (d = 0 AND (dim > 0 OR t IN ('*', '&', '[', ']', {quals}, {prim})))), '') AS base_key
  FROM lists l LEFT JOIN marked m ON m.s = l.s GROUP BY l.s)"""
