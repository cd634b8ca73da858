"""The queries of the operators for training data, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, ledger, mixing, splitter, subjects, survivors, terms
from orrery.plans.type_sql import NAME, keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": ledger.written_type_copies,
    "p1_written_types": ledger.written_types,
    "p2_found": splitter.oversized,
    "p2_pieces": splitter.all_pieces,
    "p2_round_trip": splitter.round_trip,
    "p4_found": terms.terms_found,
    "p4_terms": terms.marked_terms,
    "p5_found": survivors.best_rows,
    "p5_survivors": survivors.type_survivors,
    "p7_ids": bpe.encoded_documents,
    "p8_mix": mixing.training_order,
    "p8_shares": mixing.reached_shares,
    "p9_found": subjects.subjects_found,
    "p9_composition": subjects.composition,
}

_P1 = f"WITH {keys('SELECT type_string AS s FROM type_references')}"
_P4 = """WITH records AS (
  SELECT 'type_references' AS table_name, id, max(type_string) AS s FROM type_references GROUP BY id
  UNION ALL SELECT 'struct_members', id, max(type_string) FROM struct_members GROUP BY id),
lists AS (SELECT table_name, list_transform(regexp_extract_all(s, '[\\p{L}\\p{Nd}_]+'), lambda x: lower(x)) AS l FROM records),
each AS (SELECT table_name, unnest(l) AS term, 1 AS o, 0 AS r FROM lists UNION ALL SELECT table_name, unnest(list_distinct(l)), 0, 1 FROM lists),
totals AS (SELECT table_name, count(*) AS total FROM records GROUP BY table_name),
counts AS (SELECT table_name, term, sum(o)::BIGINT AS occurrences, sum(r)::BIGINT AS records FROM each GROUP BY table_name, term),
p4 AS (SELECT c.*, CASE WHEN records < min_records THEN 'rare' WHEN records > max_record_share * total THEN 'common' END AS mark
  FROM counts c JOIN totals USING (table_name) JOIN term_limits USING (table_name))
"""

_P5 = f"""WITH tnames AS (SELECT *, {NAME} AS s FROM types),
{keys("SELECT s FROM tnames")},
counts AS (SELECT struct_id, count(DISTINCT id) AS members FROM struct_members GROUP BY struct_id),
braces AS (SELECT id, regexp_replace(source, '[^{{}}]', '', 'g') AS b FROM types),
chars AS (SELECT id, unnest(string_split(b, '')) AS c, generate_subscripts(string_split(b, ''), 1) AS i FROM braces WHERE b <> ''),
depth AS (SELECT id, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS d FROM chars WHERE i >= 1),
whole AS (SELECT DISTINCT id FROM depth WHERE d = 0),
p5 AS (SELECT full_key, t.id, t.loaded_at, coalesce(members, 0) AS members, t.id IN (SELECT id FROM whole) AS whole
  FROM tnames t JOIN k USING (s) LEFT JOIN counts c ON c.struct_id = t.id),
best AS (SELECT full_key, count(*) AS n, min(id) AS first_id, arg_max(id, (members, loaded_at, -id)) AS members_from_id,
  arg_max(id, (loaded_at, -id)) FILTER (whole) AS source_from_id FROM p5 GROUP BY full_key)
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1
    + """, least AS (SELECT id, min(id) OVER (PARTITION BY full_key) AS first_id FROM type_references JOIN k ON s = type_string)
SELECT first_id, id AS copy_id FROM least WHERE id <> first_id""",
    "p1_written_types": _P1
    + """ SELECT min(id) AS first_id, arg_min(type_string, id) AS type_string, count(*) AS copies
FROM type_references JOIN k ON s = type_string GROUP BY full_key""",
    "p2_found": """SELECT DISTINCT table_name, id AS row_id FROM types, split_limits WHERE table_name = 'types' AND length(source) > max_chars
UNION SELECT table_name, id FROM function_bodies, split_limits WHERE table_name = 'function_bodies' AND length(fully_qualified_name) > max_chars""",
    "p2_round_trip": """SELECT 'types' AS table_name, id AS row_id, md5(max(source)) AS digest, true AS fits FROM types GROUP BY id HAVING length(max(source)) > 0
UNION ALL SELECT 'function_bodies', id, md5(max(fully_qualified_name)), true FROM function_bodies GROUP BY id HAVING length(max(fully_qualified_name)) > 0""",
    "p4_found": _P4 + "SELECT table_name, term, mark FROM p4 WHERE mark IS NOT NULL",
    "p5_found": _P5 + "SELECT first_id, members_from_id, source_from_id FROM best WHERE n > 1",
    "p4_terms": _P4 + "SELECT table_name, term, occurrences, records, mark FROM p4",
}
