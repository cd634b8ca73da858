"""The queries of problems 3 and 6, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.operators import hierarchy, orphans
from orrery.plans.type_sql import NAME, keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": orphans.type_orphans,
    "p3_report": lambda spark, d: orphans.orphan_report(orphans.type_orphans(spark, d)),
    "p6_found": hierarchy.type_roots,
    "p6_paths": hierarchy.type_paths,
    "p6_descendants": hierarchy.type_descendants,
    "p6_circles": hierarchy.type_circles,
}

_P3 = f"""WITH refs AS (
  SELECT 'type_references' AS table_name, id AS row_id, loaded_at, referenced_type_id AS ref, type_string AS s FROM type_references
  UNION SELECT 'type_inheritances', id, loaded_at, related_type_id, related_type_string FROM type_inheritances),
tnames AS (SELECT id, loaded_at, {NAME} AS s FROM types),
{keys("SELECT s FROM refs WHERE ref IS NULL AND s NOT LIKE '%(%' UNION ALL SELECT s FROM tnames UNION ALL SELECT name FROM primitive_types UNION ALL SELECT fully_qualified_name FROM type_removals")},
ids AS (SELECT id, min(loaded_at) AS since FROM types GROUP BY id),
names AS (SELECT full_key, min(loaded_at) AS since FROM tnames JOIN k USING (s) GROUP BY full_key),
gone AS (SELECT DISTINCT full_key FROM type_removals JOIN k ON s = fully_qualified_name),
prim AS (SELECT DISTINCT full_key FROM primitive_types JOIN k ON s = name),
judged AS (
  SELECT table_name, row_id, refs.loaded_at, since, ids.id IS NOT NULL AS here, ref IN (SELECT type_id FROM type_removals) AS gone
  FROM refs LEFT JOIN ids ON ids.id = ref WHERE ref IS NOT NULL
  UNION ALL
  SELECT table_name, row_id, refs.loaded_at, since, names.full_key IS NOT NULL, base_key IN (SELECT full_key FROM gone)
  FROM refs JOIN k USING (s) LEFT JOIN names ON names.full_key = base_key
  WHERE ref IS NULL AND s NOT LIKE '%(%' AND base_key NOT IN (SELECT full_key FROM prim)),
p3 AS (SELECT table_name, row_id, strftime(loaded_at, '%Y-%m') AS load_month,
  CASE WHEN here THEN 'late' WHEN gone THEN 'deleted' ELSE 'missing' END AS state FROM judged WHERE NOT here OR since > loaded_at)
"""

_LINKS = """WITH RECURSIVE links AS (
  SELECT 'inheritance' AS relation, parent_type_id AS c, related_type_id AS p FROM type_inheritances
  WHERE parent_type_id IN (SELECT id FROM types) AND related_type_id IN (SELECT id FROM types)
  UNION SELECT 'nesting', id, parent_type_id FROM types WHERE parent_type_id IN (SELECT id FROM types)),
reach AS (SELECT relation, c, p FROM links UNION SELECT r.relation, r.c, l.p FROM reach r JOIN links l ON l.relation = r.relation AND l.c = r.p),
round AS (SELECT DISTINCT relation, c FROM reach WHERE c = p),
bad AS (SELECT relation, c FROM round UNION SELECT r.relation, r.c FROM reach r JOIN round o ON o.relation = r.relation AND o.c = r.p),
good AS (SELECT l.* FROM links l ANTI JOIN bad b ON b.relation = l.relation AND b.c = l.c),
steps AS (SELECT relation, c, p, 1 AS d FROM good UNION SELECT s.relation, s.c, g.p, d + 1 FROM steps s JOIN good g ON g.relation = s.relation AND g.c = s.p),
least AS (SELECT relation, c, p, min(d) AS d FROM steps GROUP BY ALL),
further AS (SELECT relation, c, p, 1 AS d FROM links UNION SELECT s.relation, s.c, g.p, d + 1 FROM further s JOIN links g ON g.relation = s.relation AND g.c = s.p WHERE d < 150),
far AS (SELECT relation, c, p, min(d) AS d FROM further GROUP BY ALL)
"""

ORACLES: dict[str, str] = {
    "p3_found": _P3 + "SELECT * FROM p3",
    "p3_report": _P3 + "SELECT table_name, load_month, state, count(*) AS n FROM p3 GROUP BY ALL",
    "p6_found": _LINKS
    + """SELECT relation, c AS type_id, p AS root_id, d::INT AS depth FROM least r
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.relation = r.relation AND l.c = r.p)
UNION ALL SELECT relation, c, -1, -1 FROM bad""",
    "p6_paths": _LINKS.replace(
        "least AS",
        """ways AS (SELECT relation, c, p, [p] AS path FROM good UNION ALL SELECT w.relation, w.c, g.p, list_append(path, g.p) FROM ways w JOIN good g ON g.relation = w.relation AND g.c = w.p),
least AS""",
    )
    + """SELECT relation, c AS type_id, p AS root_id, len(min(path))::INT AS depth, c || '/' || array_to_string(min(path), '/') AS path
FROM (SELECT relation, c, p, path FROM ways w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.relation = w.relation AND l.c = w.p)
  QUALIFY len(path) = min(len(path)) OVER (PARTITION BY relation, c, p)) GROUP BY relation, c, p""",
    "p6_descendants": _LINKS + "SELECT relation, p AS type_id, c AS descendant_id, d::INT AS depth FROM far",
    "p6_circles": _LINKS
    + """SELECT l.relation, l.c AS child_id, l.p AS parent_id FROM links l
WHERE l.c = l.p OR EXISTS (SELECT 1 FROM reach r WHERE r.relation = l.relation AND r.c = l.p AND r.p = l.c)""",
}
