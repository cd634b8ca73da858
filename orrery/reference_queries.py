"""A query per operator of the engine, over the whole tables of a catalog, and SQL to check it by.

Names begin with the operator's number in the survey: ``f`` filters, ``r`` projections, ``j`` joins, ``a`` aggregations, ``w`` windows, ``l``
orders and limits, ``o`` sets, ``g`` graphs, ``x`` strings, ``y`` layout, ``c`` texts, ``e`` the pipeline, ``d`` changes, ``parse`` parsers.
Arrays come out joined to strings, so that any engine hashes them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.functions.fixed import PRIMITIVE_COMBINATIONS, PRIMITIVE_NAMES, PRIMITIVE_SIZES, REMAPS, RESERVED
from orrery.functions.target import mapped
from orrery.operators import catalog as K
from orrery.operators import graph, layout, methods, pipeline, render, resolution, rules
from orrery.operators.catalog import Catalog, first_per, gathered
from orrery.sources import listings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _esc(words) -> str:
    return "|".join("".join(f"\\{c}" if not (c.isalnum() or c in "_ ") else c for c in w) for w in words)


# SQL for the string functions, as macros in Python.
_SP = r"[\s\p{Z}]"
TRIM = lambda c: f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
NORM = lambda c: f"trim(replace(replace(replace(regexp_replace({c}, '{_SP}+', ' ', 'g'), ' *', '*'), ' &', '&'), ' >', '>'))"
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '/\\*.*?\\*/', '', 'gs'), '//[^\\r\\n]*', '', 'g')"


def BASE(c: str) -> str:
    bare = TRIM(f"regexp_replace(regexp_replace({TRIM(c)}, '[*&\\s\\p{{Z}}]+$', ''), '^const ', '')")
    bare = TRIM(f"regexp_replace({bare}, '^(.[^<]*)<.*$', '\\1', 's')")
    return f"regexp_replace({bare}, '^.*::(.)', '\\1', 's')"


_PRIMS = _in(dict.fromkeys(x.lower() for x in (*PRIMITIVE_NAMES, *PRIMITIVE_COMBINATIONS)))
PRIM = lambda c: f"coalesce(lower({NORM(c)}) IN ({_PRIMS}) OR lower({BASE(NORM(c))}) IN ({_PRIMS}), false)"
MEMBERS = "(SELECT DISTINCT * FROM struct_members)"
BASES = "(SELECT DISTINCT * FROM type_inheritances)"
BODIES = "(SELECT DISTINCT * FROM function_bodies)"
BY_NAME = "(SELECT stored_fully_qualified_name AS name, min(id) AS type_id FROM types WHERE length(stored_fully_qualified_name) > 0 GROUP BY 1)"


# Filters.
query("f1_type_by_id", "SELECT id, base_name, kind FROM types WHERE id = 7 LIMIT 1")(lambda c: c.by_id("types", 7).select("id", "base_name", "kind"))
query("f2_types_in_namespace", "SELECT id, base_name FROM types WHERE namespace = 'Core'")(lambda c: c.types_in("Core").select("id", "base_name"))
query("f3_types_of_kind", "SELECT id, base_name FROM types WHERE kind = 'Enum'")(lambda c: c.types_of_kind("Enum").select("id", "base_name"))
query("f4_type_by_full_name", "SELECT id, base_name FROM types WHERE stored_fully_qualified_name = 'Core::LedgeTaskDof' ORDER BY id LIMIT 1")(lambda c: c.type_named("Core::LedgeTaskDof").select("id", "base_name"))
query("f5_types_not_ignored", "SELECT id FROM types WHERE NOT is_ignored")(lambda c: c.all_types().select("id"))
query(
    "f6_search_types",
    "SELECT id, base_name FROM types WHERE NOT is_ignored AND (contains(lower(base_name), 'quota') OR contains(lower(namespace), 'quota') OR contains(lower(stored_fully_qualified_name), 'quota'))",
)(lambda c: c.search("QuoTa").select("id", "base_name"))
query("f7_bases_of_type", f"SELECT parent_type_id, related_type_id, ord FROM {BASES} WHERE parent_type_id IN (SELECT id FROM types)")(lambda c: c.children("type_inheritances", "parent_type_id", c.types).select("parent_type_id", "related_type_id", "ord"))
query("f7_derived_types", f"SELECT related_type_id, count(*) AS n FROM {BASES} WHERE related_type_id IS NOT NULL GROUP BY 1")(lambda c: c.bases.where("related_type_id IS NOT NULL").groupBy("related_type_id").agg(F.count(F.lit(1)).alias("n")))
query("f8_members_of_several", f"SELECT id, struct_id, name FROM {MEMBERS} WHERE struct_id IN (SELECT id FROM types WHERE namespace = 'Net')")(lambda c: c.children("struct_members", "struct_id", c.types_in("Net")).select("id", "struct_id", "name"))
query(
    "f9_unresolved",
    f"SELECT 'TypeReference' AS origin, id, type_string AS text FROM type_references WHERE referenced_type_id IS NULL AND length(type_string) > 0 UNION ALL SELECT 'Inheritance', id, related_type_string FROM {BASES} WHERE related_type_id IS NULL AND length(related_type_string) > 0",
)(lambda c: c.unresolved_with_primitives())
_UNRESOLVED = f"""SELECT * FROM (SELECT 'TypeReference' AS origin, id, type_string AS text FROM type_references WHERE referenced_type_id IS NULL AND length(type_string) > 0
UNION ALL SELECT 'Inheritance', id, related_type_string FROM {BASES} WHERE related_type_id IS NULL AND length(related_type_string) > 0) WHERE NOT {PRIM("text")}"""
query("f10_unresolved_not_primitive", _UNRESOLVED)(lambda c: c.unresolved())
query("f11_primitive", f"SELECT DISTINCT type_string, {PRIM('type_string')} AS is_primitive FROM struct_members")(lambda c: c.members.select("type_string").distinct().select("type_string", S.is_primitive(F.col("type_string")).alias("is_primitive")))
_SHOWN = f"""coalesce(lower(trim(regexp_replace(trim(type_string), '[*&]$', ''))) IN ({_in(dict.fromkeys(x.lower() for x in PRIMITIVE_NAMES))})
OR regexp_replace(lower(trim(regexp_replace(trim(type_string), '[*&]$', ''))), '\\s+', ' ', 'g') IN ({_in(x.lower() for x in PRIMITIVE_COMBINATIONS)}), false)"""
query("f12_primitive_shown", f"SELECT DISTINCT type_string, {_SHOWN} AS is_primitive FROM struct_members")(lambda c: c.members.select("type_string").distinct().select("type_string", S.is_primitive_shown(F.col("type_string")).alias("is_primitive")))
_SIZED = _in(dict.fromkeys(x.lower() for x in (*PRIMITIVE_SIZES, *PRIMITIVE_NAMES)))
query("f13_primitive_sized", f"SELECT name, coalesce(lower(name) IN ({_SIZED}), false) AS is_sized FROM primitive_types")(lambda c: c.table("primitive_types").select("name", S.is_sized_primitive(F.col("name")).alias("is_sized")))
query("f14_ignored_names", "SELECT id, coalesce(regexp_matches(base_name, '^(Led|Arc)|(Kor|_vtbl)$') AND base_name NOT IN ('LedgeTaskDof', 'ArcPacketZef'), false) AS ignored FROM types")(
    lambda c: c.types.select("id", S.should_ignore(F.col("base_name"), ("Led", "Arc"), ("Kor", "_vtbl"), ("LedgeTaskDof", "ArcPacketZef")).alias("ignored"))
)
query("f15_group_of_type", "SELECT id FROM types WHERE (base_name = 'LedgeTaskDof' AND coalesce(namespace, '') = 'Core') OR base_type_path = 'Core::LedgeTaskDof'")(lambda c: c.group("LedgeTaskDof", "Core").select("id"))
query("f16_without_dollar", "SELECT id FROM types WHERE base_name NOT LIKE '$%'")(lambda c: c.named_without("$").select("id"))
query("f17_work_items", "SELECT id, kind AS entity_type, coalesce(stored_fully_qualified_name, base_name, 'Unknown') AS full_name FROM types WHERE NOT is_ignored AND kind IN ('Struct', 'Class')")(lambda c: c.work_items(("Struct", "Class")))
query("f17_method_items", f"SELECT id, 'StructMethod' AS entity_type, coalesce(fully_qualified_name, 'Unknown') AS full_name FROM {BODIES} WHERE parent_id IN (SELECT id FROM types WHERE NOT is_ignored)")(lambda c: c.method_items())
query("f20_typedef_kinds", "SELECT id, CASE WHEN regexp_matches(source, '\\(\\s*(__\\w+\\s+)?\\*\\s*\\w+\\s*\\)') THEN 'pointer' WHEN regexp_matches(source, '__(cdecl|stdcall|thiscall|fastcall)\\s+\\w+\\s*\\(') THEN 'signature' ELSE 'simple' END AS form FROM types WHERE kind = 'Typedef' AND source IS NOT NULL")(
    lambda c: c.types.where("kind = 'Typedef' AND source IS NOT NULL").select("id", S.typedef_kind(F.col("source")).alias("form"))
)
query("f21_table_pointers", f"SELECT id FROM {MEMBERS} WHERE regexp_matches(name, 'vftable|vtbl|__vfptr') OR contains(type_string, '_vtbl') OR contains(type_string, 'Vtbl')")(
    lambda c: c.members.where(S.is_table_pointer(F.col("name"), F.col("type_string"))).select("id")
)
query("f22_suppressed_lines", f"SELECT id, regexp_matches(fully_qualified_name, '__userpurge|operator\\*') AS suppressed FROM {BODIES} WHERE fully_qualified_name IS NOT NULL")(
    lambda c: c.bodies.where("fully_qualified_name IS NOT NULL").select("id", S.is_suppressed(F.col("fully_qualified_name")).alias("suppressed"))
)
query("f23_request_kind", "SELECT event_id, CASE WHEN props LIKE '{%' AND contains(props, '\"k\"') THEN 'Verification' ELSE 'Generation' END AS kind FROM events")(
    lambda c: c.table("events").select("event_id", F.when(F.col("props").startswith("{") & F.contains("props", F.lit('"k"')), "Verification").otherwise("Generation").alias("kind"))
)
_STATIC_LINES = "(SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line FROM documents)"
query("f25_static_lines", f"SELECT doc_id, count(*) AS n FROM {_STATIC_LINES} WHERE NOT contains(line, 'vftable') AND regexp_matches(trim(line), '^([0-9A-F]{{16}})\\s+(.+?)\\s+\\d+\\s+bytes\\s+\\[(.+?)\\]$') GROUP BY doc_id")(
    lambda c: c.table("documents").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line")).where(S.is_static_line(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
)
query("f26_function_marks", f"SELECT doc_id, count(*) AS n FROM {_STATIC_LINES} WHERE regexp_matches(trim(line), '^//-+ \\(([0-9A-F]+)\\) -+') GROUP BY doc_id")(
    lambda c: c.table("documents").select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line")).where(S.is_function_mark(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
)

# Projections.
query("r1_lookup", "SELECT id, base_name, namespace, stored_fully_qualified_name FROM types WHERE NOT is_ignored")(lambda c: c.lookup())
query("r3_full_names", "SELECT id, CASE WHEN coalesce(namespace, '') = '' THEN base_name ELSE namespace || '::' || base_name END AS full_name FROM types")(
    lambda c: c.types.select("id", S.full_name(F.col("namespace"), F.col("base_name")).alias("full_name"))
)
query("r5_unresolved_sample", f"SELECT concat_ws(': ', origin, text) AS sample FROM ({_UNRESOLVED}) ORDER BY CASE origin WHEN 'TypeReference' THEN 0 ELSE 1 END, id LIMIT 5")(lambda c: c.unresolved_sample(5))
query("r9_type_from_path", "SELECT id, namespace || '/' || base_name AS path FROM types WHERE namespace = 'Tools::Import'")(lambda c: c.types_in("Tools::Import").select("id", S.type_path(F.col("namespace"), F.col("base_name")).alias("path")))
query("r10_ancestor_paths", "SELECT DISTINCT namespace, array_to_string(string_split(namespace, '::')[1:n], '/') AS path FROM types, range(1, 9) AS r(n) WHERE length(namespace) > 0 AND n <= len(string_split(namespace, '::'))")(
    lambda c: c.types.where("length(namespace) > 0").select("namespace", F.explode(S.prefixes_of(F.replace("namespace", F.lit("::"), F.lit("/")))).alias("path")).distinct()
)
query("r11_links", "SELECT id, '/type/' || CASE WHEN coalesce(namespace, '') = '' THEN '' ELSE replace(namespace, '::', '/') || '/' END || base_name AS link FROM types")(
    lambda c: c.types.select("id", S.type_link(F.col("namespace"), F.col("base_name")).alias("link"))
)

# Joins.
def _enum_terms(c: Catalog) -> DataFrame:
    """owner_id, term: the names of enums and those of their members."""
    enums = c.types_of_kind("Enum").select(F.col("id").alias("owner_id"), F.col("base_name").alias("term"))
    values = _enum_values(c).select(F.col("enum_id").alias("owner_id"), F.col("name").alias("term"))
    return enums.unionByName(values.join(enums.select("owner_id").distinct(), "owner_id", "left_semi"))


_join = lambda col, order: F.array_join(F.transform(col, lambda x: F.coalesce(x[order].cast("string"), F.lit("-"))), ",")
query("j1_types_with_bases", f"SELECT t.id, coalesce(string_agg(coalesce(b.related_type_id::VARCHAR, '-'), ',' ORDER BY b.ord, b.id) FILTER (b.id IS NOT NULL), '') AS bases FROM types t LEFT JOIN {BASES} b ON b.parent_type_id = t.id GROUP BY t.id")(
    lambda c: c.types_with_bases().select("id", _join("bases", "related_type_id").alias("bases"))
)
query("j2_members_with_references", f"SELECT m.id, m.struct_id, r.referenced_type_id, r.pointer_depth FROM {MEMBERS} m LEFT JOIN type_references r ON r.id = m.type_reference_id")(lambda c: c.members_with_references().select("id", "struct_id", "referenced_type_id", "pointer_depth"))
query("j3_members_with_types", f"SELECT m.id, t.base_name AS type_base_name, t.kind AS type_kind FROM {MEMBERS} m LEFT JOIN type_references r ON r.id = m.type_reference_id LEFT JOIN types t ON t.id = r.referenced_type_id")(
    lambda c: c.members_with_types().select("id", "type_base_name", "type_kind")
)
query("j4_bases_with_types", f"SELECT b.id, t.base_name AS related_base_name FROM {BASES} b LEFT JOIN types t ON t.id = b.related_type_id")(lambda c: c.bases_with_types().select("id", "related_base_name"))
query("j7_bodies_with_owners", f"SELECT b.id, t.base_name AS owner_base_name FROM {BODIES} b LEFT JOIN types t ON t.id = b.parent_id")(lambda c: c.bodies_with_owners().select("id", "owner_base_name"))
query(
    "j9_whole_types",
    f"""SELECT t.id, (SELECT count(*) FROM {BASES} b WHERE b.parent_type_id = t.id)::INT AS n_bases, (SELECT count(*) FROM {MEMBERS} m WHERE m.struct_id = t.id)::INT AS n_members,
(SELECT count(*) FROM {BODIES} f WHERE f.parent_id = t.id)::INT AS n_bodies FROM types t""",
)(lambda c: c.whole_types().select("id", F.size("bases").alias("n_bases"), F.coalesce(F.size("members"), F.lit(0)).alias("n_members"), F.coalesce(F.size("bodies"), F.lit(0)).alias("n_bodies")))
query("j10_ids_by_name", BY_NAME[1:-1])(lambda c: resolution.ids_by_name(c.types))
query("j11_reference_ids", f"SELECT m.id, r.ref FROM {MEMBERS} m LEFT JOIN (SELECT type_string, min(id) AS ref FROM type_references WHERE type_string IS NOT NULL GROUP BY 1) r USING (type_string)")(
    lambda c: resolution.reference_ids(c.members, c.references).select("id", "ref")
)
_OWNER = "CASE WHEN contains(full_name, '::') THEN left(full_name, length(full_name) - length(list_last(string_split(full_name, '::'))) - 2) END"
_SCOPED = f"(SELECT id, regexp_extract(fully_qualified_name, '([\\w:~]+)\\(', 1) AS full_name FROM {BODIES} WHERE fully_qualified_name IS NOT NULL)"
query("j12_owners_of_functions", f"SELECT f.id, f.full_name, t.type_id AS parent_id FROM (SELECT *, {_OWNER} AS owner FROM {_SCOPED}) f LEFT JOIN {BY_NAME} t ON t.name = f.owner")(
    lambda c: resolution.owners(c.bodies.where("fully_qualified_name IS NOT NULL").select("id", F.regexp_extract("fully_qualified_name", r"([\w:~]+)\(", 1).alias("full_name")), c.types, "full_name").select("id", "full_name", "parent_id")
)
_J14 = f"""WITH named AS {BY_NAME}, asked AS (SELECT *, coalesce(fully_qualified_type, '') AS k1, {BASE("type_string")} AS k3, {NORM(BASE("type_string"))} AS k5, {BASE(NORM(BASE("type_string")))} AS k6 FROM type_references)
SELECT a.id, coalesce(a.referenced_type_id, CASE WHEN length(a.type_string) > 0 AND NOT {PRIM("a.type_string")} THEN coalesce(n1.type_id, n3.type_id, n5.type_id, n6.type_id) END) AS referenced_type_id
FROM asked a LEFT JOIN named n1 ON n1.name = k1 LEFT JOIN named n3 ON n3.name = k3 LEFT JOIN named n5 ON n5.name = k5 LEFT JOIN named n6 ON n6.name = k6"""
query("j14_resolved_references", _J14)(lambda c: resolution.resolve_references(c.references, c.types).select("id", "referenced_type_id"))
query(
    "j15_resolved_bases",
    f"""WITH named AS {BY_NAME} SELECT b.id, coalesce(b.related_type_id, CASE WHEN length(related_type_string) > 0 AND NOT {PRIM("related_type_string")} THEN coalesce(n1.type_id, n2.type_id) END) AS related_type_id
FROM {BASES} b LEFT JOIN named n1 ON n1.name = related_type_string LEFT JOIN named n2 ON n2.name = {NORM("related_type_string")}""",
)(lambda c: resolution.resolve_bases(c.bases, c.types).select("id", "related_type_id"))
query("j17_pending_work", "SELECT doc_id FROM documents ANTI JOIN (SELECT DISTINCT doc_id FROM doc_labels) USING (doc_id)")(
    lambda c: pipeline.pending(
        c.table("documents").select("doc_id", F.lit("Document").alias("entity_type"), F.col("doc_id").cast("string").alias("full_name")),
        c.table("doc_labels").select(F.lit("Label").alias("stage"), F.lit("Document").alias("entity_type"), F.col("doc_id").cast("string").alias("full_name"), F.lit("Success").alias("status")), "Label",
    ).select("doc_id")
)
query("j18_new_types", "SELECT count(*) AS n FROM types WHERE stored_fully_qualified_name NOT IN (SELECT fully_qualified_name FROM type_removals WHERE fully_qualified_name IS NOT NULL)")(
    lambda c: K.new_rows(c.table("type_removals").select(F.col("fully_qualified_name").alias("stored_fully_qualified_name")), c.types.where("stored_fully_qualified_name IS NOT NULL"), "stored_fully_qualified_name").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "j21_names_in_scope",
    f"""WITH named AS {BY_NAME}, asked AS (SELECT DISTINCT base_name AS name, coalesce(namespace, '') AS scope FROM types WHERE base_name IS NOT NULL),
tries AS (SELECT name, scope, 0 AS step, name AS full FROM asked UNION ALL SELECT name, scope, len(string_split(scope, '::')) - n + 1, array_to_string(string_split(scope, '::')[1:n], '::') || '::' || name
  FROM asked, range(1, 12) r(n) WHERE scope <> '' AND n <= len(string_split(scope, '::'))),
best AS (SELECT t.name, scope, arg_min(type_id, step) AS scoped FROM tries t JOIN named ON named.name = t.full GROUP BY ALL),
bare AS (SELECT base_name AS name, min(id) AS bare FROM types GROUP BY 1)
SELECT name, scope, coalesce(scoped, bare) AS type_id FROM asked LEFT JOIN best USING (name, scope) LEFT JOIN bare USING (name)""",
)(lambda c: resolution.in_scope(c.types.where("base_name IS NOT NULL").select(F.col("base_name").alias("name"), F.col("namespace").alias("scope")), c.types))
query(
    "j25_nested_types",
    f"""WITH t AS (SELECT id, base_name, coalesce(namespace, '') AS ns, is_vtable FROM types), named AS {BY_NAME},
bb AS (SELECT base_name, ns, min(id) AS parent_id FROM t GROUP BY ALL),
links AS (SELECT t.id, t.base_name, bb.parent_id, 0 AS r FROM t JOIN bb ON bb.ns = t.ns AND bb.base_name = regexp_replace(t.base_name, '_vtbl$', '') WHERE ends_with(t.base_name, '_vtbl')
  UNION ALL SELECT t.id, t.base_name, type_id, CASE WHEN is_vtable THEN 0 ELSE 1 END FROM t JOIN named ON named.name = t.ns WHERE NOT ends_with(t.base_name, '_vtbl') AND t.ns <> '')
SELECT parent_id, l.id AS child_id, (row_number() OVER (PARTITION BY parent_id ORDER BY r, l.base_name, l.id))::INT AS rank FROM links l JOIN t p ON p.id = parent_id WHERE l.id <> parent_id AND l.base_name <> p.base_name""",
)(lambda c: resolution.nested_types(c.types))
query(
    "j26_enclosing_types",
    f"""WITH named AS {BY_NAME}, tries AS (SELECT id, type_id, len(string_split(namespace, '::')) - n AS step FROM types, range(1, 12) r(n), named
  WHERE length(namespace) > 0 AND n <= len(string_split(namespace, '::')) AND named.name = array_to_string(string_split(namespace, '::')[1:n], '::') AND id <> type_id)
SELECT id, parent_id FROM types LEFT JOIN (SELECT id, arg_min(type_id, step) AS parent_id FROM tries GROUP BY id) USING (id)""",
)(lambda c: resolution.enclosing_types(c.types))
query(
    "j27_provenance",
    f"""WITH o AS (SELECT id, type_string AS text FROM type_references WHERE referenced_type_id IS NULL AND length(type_string) > 0 AND NOT {PRIM("type_string")}),
u AS (SELECT o.id, text, 'Member' AS used_as, struct_id AS user_id, name AS user_name FROM o JOIN {MEMBERS} m ON m.type_reference_id = o.id
  UNION ALL SELECT o.id, text, 'Inheritance', parent_type_id, NULL FROM o JOIN {BASES} b ON b.related_type_string = text)
SELECT * FROM u UNION ALL SELECT id, text, 'TypeReference', NULL, NULL FROM o WHERE id NOT IN (SELECT id FROM u)""",
)(lambda c: resolution.provenance(c))
query(
    "j28_texts_by_terms",
    """WITH b AS (SELECT id, regexp_extract(source, '\\{(.*)\\}', 1, 's') AS body FROM types WHERE kind = 'Enum' AND regexp_matches(source, '(?s)^/\\*\\s*\\d+\\s*\\*/\\r?\\nenum [^;{]*\\{.*\\}')),
m AS (SELECT id, unnest(string_split(body, ',')) AS part FROM b),
named AS (SELECT id, regexp_extract(part, '^\\s*([a-zA-Z_]\\w*)', 1) AS name FROM m WHERE regexp_matches(part, '(?s)^\\s*([a-zA-Z_]\\w*)\\s*(?:=\\s*(.*?))?\\s*$')),
terms AS (SELECT id AS owner_id, lower(base_name) AS term FROM types WHERE kind = 'Enum' AND length(trim(base_name)) > 0 UNION SELECT id, lower(name) FROM named),
hits AS (SELECT owner_id, b.id AS body_id, count(*) AS hits FROM (SELECT DISTINCT id, lower(body_text) AS t FROM function_bodies) b JOIN terms ON contains(t, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY hits DESC, body_id) AS n FROM hits) SELECT owner_id, body_id, hits FROM r WHERE n <= 20""",
)(lambda c: render.term_hits(_enum_terms(c), c.bodies.select("id", "body_text").distinct(), "body_text"))
query("j35_lookup_by_name", "SELECT stored_fully_qualified_name, max(id) AS id FROM types WHERE NOT is_ignored AND stored_fully_qualified_name IS NOT NULL GROUP BY 1")(lambda c: c.lookup_by_name())
query("j35_lookup_by_base_name", "SELECT lower(base_name) AS base_name, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM types WHERE NOT is_ignored GROUP BY 1")(lambda c: c.lookup_by_base_name().select("base_name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))

# Aggregations and windows.
query("a1_members_by_struct", f"SELECT struct_id, string_agg(coalesce(name, '-'), ',' ORDER BY decl_order, id) AS names FROM {MEMBERS} WHERE struct_id IS NOT NULL GROUP BY 1")(
    lambda c: gathered(c.members, "struct_id", ["decl_order", "id"], "name").select("struct_id", _join("items", "name").alias("names"))
)
query("a2_first_per_name", "SELECT base_name, arg_min(kind, id) AS kind, min(id) AS id FROM types GROUP BY 1")(lambda c: first_per(c.types.select("base_name", "id", "kind"), ["base_name"], ["id"]).select("base_name", "kind", "id"))
query("a3_duplicate_names", "SELECT stored_fully_qualified_name, count(*) AS n FROM types WHERE length(stored_fully_qualified_name) > 0 GROUP BY 1 HAVING count(*) > 1")(
    lambda c: K.duplicates(c.types, "stored_fully_qualified_name")
)
query("a5_unresolved_count", f"SELECT count(*) AS n FROM ({_UNRESOLVED})")(lambda c: c.unresolved_count())
query("a9_distinct_type_strings", "SELECT DISTINCT type_string FROM struct_members")(lambda c: c.members.select("type_string").distinct())
query("a12_member_texts", f"SELECT struct_id, string_agg(coalesce(type_string, '') || ' ' || coalesce(name, ''), ';' ORDER BY decl_order, id) AS content FROM {MEMBERS} WHERE struct_id IS NOT NULL GROUP BY 1")(
    lambda c: render.joined_lines(c.members.where("struct_id IS NOT NULL").select("struct_id", "decl_order", "id", F.concat(F.coalesce("type_string", F.lit("")), F.lit(" "), F.coalesce("name", F.lit(""))).alias("text")), "struct_id", ["decl_order", "id"], between=";")
)
query(
    "a16_folder_tree",
    """WITH p AS (SELECT CASE WHEN coalesce(namespace, '') IN ('', 'Global') THEN '' ELSE replace(namespace, '::', '/') END AS path FROM types),
nodes AS (SELECT '' AS full_path UNION SELECT array_to_string(string_split(path, '/')[1:n], '/') FROM p, range(1, 12) r(n) WHERE path <> '' AND n <= len(string_split(path, '/')))
SELECT full_path, CASE WHEN full_path = '' THEN NULL WHEN contains(full_path, '/') THEN regexp_replace(full_path, '/[^/]*$', '') ELSE '' END AS parent,
CASE WHEN full_path = '' THEN 'Root' ELSE list_last(string_split(full_path, '/')) END AS name, (SELECT count(*) FROM p WHERE path = full_path) AS n_items FROM nodes""",
)(lambda c: rules.path_tree(c.types.select(F.replace("namespace", F.lit("::"), F.lit("/")).alias("path"))))
query("a18_first_base", f"SELECT parent_type_id, arg_min(related_type_id, (ord, id)) AS base_id FROM {BASES} WHERE related_type_id IS NOT NULL GROUP BY 1")(
    lambda c: c.first_bases()
)
query("w1_overload_index", f"SELECT id, (row_number() OVER (PARTITION BY struct_id, name ORDER BY decl_order, id) - 1)::INT AS overload FROM {MEMBERS}")(
    lambda c: K.numbered(c.members, ["struct_id", "name"], ["decl_order", "id"], "overload").select("id", "overload")
)
query("w2_declaration_order", f"SELECT id, (row_number() OVER (PARTITION BY struct_id ORDER BY decl_order, id) - 1)::INT AS place FROM {MEMBERS}")(
    lambda c: K.numbered(c.members, ["struct_id"], ["decl_order", "id"], "place").select("id", "place")
)
query(
    "w4_names_numbered",
    f"SELECT id, CASE WHEN count(*) OVER (PARTITION BY struct_id, name) > 1 THEN name || '_' || row_number() OVER (PARTITION BY struct_id, name ORDER BY decl_order, id) ELSE name END AS name FROM {MEMBERS} WHERE name IS NOT NULL",
)(lambda c: K.told_apart(c.members.where("name IS NOT NULL").withColumn("struct_id", F.coalesce("struct_id", F.lit(-1))), ["struct_id"], ["decl_order", "id"], "name").select("id", "name"))
query(
    "w5_best_candidates",
    f"""WITH s AS (SELECT struct_id AS id, count(*) AS n_parts FROM {MEMBERS} WHERE struct_id IS NOT NULL GROUP BY 1), b AS (SELECT parent_type_id AS id, count(*) AS n_bases FROM {BASES} GROUP BY 1)
SELECT base_name AS generated, arg_min(id, (-coalesce(n_parts, 0), -coalesce(n_bases, 0), -coalesce(length(source), 0), id)) AS id FROM types LEFT JOIN s USING (id) LEFT JOIN b USING (id) GROUP BY 1""",
)(
    lambda c: render.best_candidates(
        c.types.withColumn("generated", F.col("base_name")),
        c.members.where("struct_id IS NOT NULL").groupBy(F.col("struct_id").alias("id")).agg(F.count(F.lit(1)).alias("n_parts")).join(c.bases.groupBy(F.col("parent_type_id").alias("id")).agg(F.count(F.lit(1)).alias("n_bases")), "id", "full_outer"),
    )
)
query("w9_first_slot", f"SELECT struct_id, lower(name) AS name, arg_min(member_offset, (decl_order, id)) AS slot FROM (SELECT * FROM {MEMBERS} WHERE member_offset IS NOT NULL AND struct_id IS NOT NULL) GROUP BY ALL")(
    lambda c: c.first_slots()
)
query("w10_signatures_once", f"SELECT fully_qualified_name, min(id) AS id FROM {BODIES} WHERE fully_qualified_name IS NOT NULL GROUP BY 1")(lambda c: c.first_bodies())
query("l2_by_name", "SELECT id, (row_number() OVER (ORDER BY base_name, id))::INT AS place FROM types")(lambda c: _numbered(c.types.select("id", "base_name"), ["base_name", "id"]))
query("l11_last_events", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")(lambda c: K.last(c.table("events"), ["ts", "event_id"], 200).select("event_id"))
query("o1_tagged_union", f"SELECT 'type' AS origin, id FROM types UNION ALL SELECT 'body', id FROM {BODIES}")(lambda c: K.tagged(type=c.types, body=c.bodies))
query("o2_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM doc_labels")(lambda c: c.table("documents").select("doc_id").subtract(c.table("doc_labels").select("doc_id")))
query("o3_set_union", "SELECT referenced_type_id AS id FROM type_references WHERE referenced_type_id IS NOT NULL UNION SELECT related_type_id FROM type_inheritances WHERE related_type_id IS NOT NULL")(
    lambda c: c.used_ids()
)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    from orrery.plans.shared import row_numbers

    return row_numbers(df, order, "place").select("id", "place")


# Graphs.
_LINKS = f"links AS (SELECT DISTINCT parent_type_id::BIGINT AS c, related_type_id::BIGINT AS p FROM {BASES} WHERE parent_type_id IN (SELECT id FROM types) AND related_type_id IN (SELECT id FROM types))"
_links = lambda c: graph.inheritance_links(c.bases, c.types)
query(
    "g2_derived_from",
    f"""WITH RECURSIVE {_LINKS}, wanted AS (SELECT DISTINCT stored_fully_qualified_name AS name FROM types WHERE NOT is_ignored AND namespace = 'Net'),
found AS (SELECT id::BIGINT AS id, name FROM types JOIN wanted ON name = stored_fully_qualified_name WHERE NOT is_ignored UNION SELECT c, name FROM found JOIN links ON p = id) SELECT * FROM found""",
)(lambda c: graph.derived_from(_links(c), c.types, c.types_in("Net").where("NOT is_ignored").select(F.col("stored_fully_qualified_name").alias("name"))))
query("g3_direct_bases", f"WITH {_LINKS} SELECT c AS child, p AS parent FROM links")(lambda c: _links(c))
query("g4_bases_of_all_classes", f"WITH RECURSIVE {_LINKS}, found AS (SELECT id::BIGINT AS id FROM types WHERE kind = 'Class' UNION SELECT p FROM found JOIN links ON c = id) SELECT id FROM found")(lambda c: graph.bases_of(_links(c), c.types_of_kind("Class")))
query("g2_closure", f"WITH RECURSIVE {_LINKS}, r AS (SELECT c, p FROM links UNION SELECT r.c, l.p FROM r JOIN links l ON l.c = r.p) SELECT c AS child, p AS parent FROM r")(lambda c: graph.closure(_links(c)))
query("g7_destructors", f"WITH RECURSIVE {_LINKS}, found AS (SELECT DISTINCT parent_id::BIGINT AS id FROM {BODIES} WHERE contains(fully_qualified_name, '~') AND parent_id IS NOT NULL UNION SELECT c FROM found JOIN links ON p = id) SELECT id FROM found")(
    lambda c: graph.with_destructor(_links(c), c.bodies.where("contains(fully_qualified_name, '~') AND parent_id IS NOT NULL").select(F.col("parent_id").alias("id")))
)
query(
    "g6_base_paths",
    """WITH r AS (SELECT id, base_name, coalesce(namespace, '') AS ns, coalesce(stored_fully_qualified_name, '') AS f FROM types),
by_name AS (SELECT DISTINCT f AS k FROM r WHERE f <> ''), by_base AS (SELECT base_name, ns, arg_min(f, id) AS v FROM r GROUP BY ALL), top AS (SELECT base_name AS k, v FROM by_base WHERE ns = ''),
a AS (SELECT r.*, b.v AS parent, CASE WHEN contains(b.v, '::') THEN string_split(b.v, '::')[1] END AS pk, CASE WHEN contains(r.ns, '::') THEN string_split(r.ns, '::')[1] END AS sk,
  CASE WHEN contains(r.base_name, '::') THEN string_split(r.base_name, '::')[1] END AS ok FROM r LEFT JOIN by_base b ON ends_with(r.base_name, '_vtbl') AND b.base_name = regexp_replace(r.base_name, '_vtbl$', '') AND b.ns = r.ns)
SELECT a.id, CASE WHEN parent IS NOT NULL THEN coalesce(p1.v, p2.k, parent) ELSE coalesce(s1.v, s2.k, same.k, o1.k, o2.v, f) END AS base_type_path FROM a
LEFT JOIN top p1 ON p1.k = pk LEFT JOIN by_name p2 ON p2.k = pk LEFT JOIN top s1 ON s1.k = sk LEFT JOIN by_name s2 ON s2.k = sk LEFT JOIN by_name same ON same.k = ns AND ns <> '' LEFT JOIN by_name o1 ON o1.k = ok LEFT JOIN top o2 ON o2.k = ok""",
)(lambda c: resolution.base_paths(c.types))
_UP = f"""WITH RECURSIVE named AS {BY_NAME}, t AS (SELECT id, base_name, coalesce(namespace, '') AS ns, coalesce(stored_fully_qualified_name, '') AS f, coalesce(base_type_path, '') AS path FROM types),
p AS (SELECT *, {BASE("path")} AS k FROM t WHERE path <> ''), two AS (SELECT base_name AS k, ns, min(id) AS b FROM t GROUP BY ALL), three AS (SELECT base_name AS k, min(id) AS c FROM t GROUP BY ALL),
up AS (SELECT p.id, coalesce(n.type_id, b, c) AS up FROM p LEFT JOIN named n ON n.name = path LEFT JOIN two USING (k, ns) LEFT JOIN three USING (k)),
root AS (SELECT id, path = '' OR path = f OR {BASE("path")} = base_name AS r FROM t),
walk AS (SELECT id, up AS pos FROM up WHERE up IS NOT NULL UNION SELECT w.id, u.up FROM walk w JOIN root ON root.id = pos AND NOT r JOIN up u ON u.id = pos WHERE u.up IS NOT NULL),
roots AS (SELECT w.id, pos AS root_id FROM walk w JOIN root ON root.id = pos AND r)
"""
query("g5_grouping_roots", _UP + "SELECT types.id, root_id FROM types LEFT JOIN roots USING (id)")(lambda c: resolution.grouping_roots(c.types))
query("j31_locations")(lambda c: rules.locations(c.types, _links(c)).select("id", "rule", "path", "file_name"))
query("a14_output_files")(lambda c: rules.grouped(c.types, rules.locations(c.types, _links(c))))

# Strings.
query("x3_without_comments", f"SELECT id, {STRIP('source')} AS text FROM types WHERE source IS NOT NULL")(lambda c: c.types.where("source IS NOT NULL").select("id", S.strip_comments(F.col("source")).alias("text")))
query("x4_normalized", f"SELECT id, {NORM('type_string')} AS text FROM type_references WHERE type_string IS NOT NULL")(lambda c: c.references.where("type_string IS NOT NULL").select("id", S.normalize_type(F.col("type_string")).alias("text")))
query("x7_identifiers", f"SELECT id, coalesce(regexp_matches(name, '^[a-zA-Z_][a-zA-Z0-9_]*$'), false) AS ok FROM {MEMBERS}")(lambda c: c.members.select("id", S.is_identifier(F.col("name")).alias("ok")))
query("x16_base_names", f"SELECT id, {BASE('type_string')} AS base FROM type_references WHERE type_string IS NOT NULL")(lambda c: c.references.where("type_string IS NOT NULL").select("id", S.base_type_name(F.col("type_string")).alias("base")))
_LINES = "(SELECT id, line FROM (SELECT id, unnest(regexp_split_to_array(source, '\\r?\\n')) AS line FROM types))"
_lines = lambda c: c.types.select("id", F.explode(F.split("source", r"\r?\n")).alias("line"))
query("x17_bit_widths", f"SELECT id, line, TRY_CAST(regexp_extract({STRIP('line')}, '\\w+\\s*:\\s*(\\d+)\\s*;?\\s*$', 1) AS INT) AS width FROM {_LINES} WHERE contains(line, ':')")(lambda c: _lines(c).where("contains(line, ':')").select("id", "line", S.bit_width(F.col("line")).alias("width")))
query("x18_alignments", "SELECT id, TRY_CAST(regexp_extract(source, '__declspec\\s*\\(\\s*align\\s*\\(\\s*(\\d+)\\s*\\)\\s*\\)', 1) AS INT) AS alignment FROM types WHERE source IS NOT NULL")(lambda c: c.types.where("source IS NOT NULL").select("id", S.alignment(F.col("source")).alias("alignment")))
query("x19_arrays", f"SELECT id, coalesce(regexp_matches({STRIP('type_string')}, '\\[\\d*\\]'), false) AS is_array, TRY_CAST(regexp_extract({STRIP('type_string')}, '\\[(\\d*)\\]', 1) AS INT) AS array_size FROM type_references")(
    lambda c: c.references.select("id", S.is_array(F.col("type_string")).alias("is_array"), S.array_size(F.col("type_string")).alias("array_size"))
)
query("x20_function_pointers", "SELECT id, coalesce(regexp_matches(trim(type_string), '^(.+?)\\s*\\(\\s*(__thiscall|__stdcall|__cdecl|__fastcall)?\\s*(\\*+)\\s*(\\w*)\\s*\\)\\s*\\((.*?)?\\)$'), false) AS is_pointer FROM type_references")(
    lambda c: c.references.select("id", S.is_function_pointer(F.col("type_string")).alias("is_pointer"))
)
query("x30_conventions", f"SELECT id, CASE lower(regexp_extract(fully_qualified_name, '(__\\w+) ', 1)) WHEN '__cdecl' THEN 'Cdecl' WHEN '__thiscall' THEN 'Thiscall' WHEN '__stdcall' THEN 'Stdcall' WHEN '__fastcall' THEN 'Fastcall' ELSE 'Cdecl' END AS convention FROM {BODIES}")(
    lambda c: c.bodies.select("id", S.calling_convention(F.regexp_extract("fully_qualified_name", r"(__\w+) ", 1)).alias("convention"))
)
_VALUES = "(SELECT DISTINCT id, unnest(regexp_extract_all(source, '=\\s*(-?[0-9xXa-fA-F]+[LlUu]*)', 1)) AS v FROM types WHERE kind = 'Enum')"
query("x31_enum_values", f"SELECT id, v, CASE WHEN regexp_matches(v, '^-?0[xX][0-9a-fA-F]{{1,15}}[LlUu]*$') THEN (CASE WHEN v LIKE '-%' THEN -1 ELSE 1 END) * ('0x' || regexp_extract(v, '^-?0[xX]([0-9a-fA-F]+)', 1))::BIGINT WHEN regexp_matches(v, '^[-+]?\\d+[LlUu]*$') THEN TRY_CAST(rtrim(v, 'LlUu') AS BIGINT) END AS value FROM {_VALUES}")(
    lambda c: c.types_of_kind("Enum").select("id", F.explode(F.regexp_extract_all("source", F.lit(r"=\s*(-?[0-9xXa-fA-F]+[LlUu]*)"), F.lit(1))).alias("v")).distinct().select("id", "v", S.enum_value(F.col("v")).alias("value"))
)
query("x32_sanitized", f"SELECT id, CASE WHEN coalesce(replace(name, '~', 'Destructor'), '') = '' THEN '_param' WHEN name IN ({_in(RESERVED)}) THEN name || '_' WHEN NOT regexp_matches(replace(name, '~', 'Destructor'), '^[\\p{{L}}_]') THEN '_' || replace(name, '~', 'Destructor') ELSE replace(name, '~', 'Destructor') END AS name FROM {MEMBERS}")(
    lambda c: c.members.select("id", S.sanitize(F.col("name")).alias("name"))
)
query("x34_addresses", f"SELECT id, '0x' || lpad(upper(to_hex(body_offset)), 8, '0') AS address FROM {BODIES} WHERE body_offset IS NOT NULL")(lambda c: c.bodies.where("body_offset IS NOT NULL").select("id", S.address(F.hex("body_offset")).alias("address")))
_ACCENTED = r"[\p{L}\p{M}\p{N}_]*[^\x00-\x7F\p{Z}\p{P}\p{S}\p{C}][\p{L}\p{M}\p{N}_]*"  # such letters are part of words, which RE2's \b doesn't know
REMAP = lambda c: f"""array_to_string(list_transform(regexp_extract_all({c}, '{_ACCENTED}|\\b(?:{_esc(sorted(REMAPS, key=lambda k: (-len(k), k)))})\\b|(?s:.)'), lambda w: CASE w {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REMAPS.items())} ELSE w END), '')"""
query("x35_remapped", f"SELECT id, {REMAP('type_string')} AS text FROM type_references WHERE type_string IS NOT NULL")(lambda c: c.references.where("type_string IS NOT NULL").select("id", S.remap(F.col("type_string")).alias("text")))
query("x36_clean_base_names", f"SELECT id, regexp_replace({BASE('type_string')}, '_vtbl$', '') AS base FROM type_references WHERE type_string IS NOT NULL")(lambda c: c.references.where("type_string IS NOT NULL").select("id", S.clean_base_name(F.col("type_string")).alias("base")))
query("x38_cache_keys", "SELECT doc_id, upper(sha256('local|0.7|' || text)) AS cache_key FROM documents WHERE text IS NOT NULL")(lambda c: c.table("documents").where("text IS NOT NULL").select("doc_id", S.cache_key(F.lit("local"), F.lit("0.7"), F.col("text")).alias("cache_key")))
_FENCED = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), '```')), chr(10))"
query("x39_without_fences", f"SELECT doc_id, {TRIM(_FENCED)} AS text FROM documents WHERE text IS NOT NULL")(
    lambda c: c.table("documents").where("text IS NOT NULL").select("doc_id", S.without_fences(F.col("text")).alias("text"))
)
query("x40_json", "SELECT event_id, TRY_CAST(props::JSON->>'k' AS BIGINT) AS k FROM events")(lambda c: c.table("events").select("event_id", F.from_json(F.regexp_extract("props", r"(?s)\{.*\}", 0), "k bigint")["k"].alias("k")))
query("x41_summaries")(lambda c: c.table("documents").select("doc_id", F.udf(pipeline.has_summary, "boolean", useArrow=True)("text").alias("ok")))
query("x42_escaped", "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text FROM documents WHERE text IS NOT NULL")(lambda c: c.table("documents").where("text IS NOT NULL").select("doc_id", S.escaped(F.col("text")).alias("text")))
query("x43_prompts", "SELECT doc_id, '<system>' || chr(10) || 's' || chr(10) || '</system>' || CASE WHEN length(text) > 0 THEN chr(10) || chr(10) || '<input>' || chr(10) || text || chr(10) || '</input>' ELSE '' END AS prompt FROM documents")(
    lambda c: c.table("documents").select("doc_id", S.prompt(system=F.lit("s"), references=F.lit(""), input=F.col("text")).alias("prompt"))
)
query("x29_target_types")(lambda c: c.references.select("type_string").distinct().select("type_string", mapped(F.col("type_string")).alias("target")))
query("parse16_type_tokens", f"SELECT doc_id, len(regexp_extract_all({REMAP('type_fqn')}, '[a-zA-Z_]\\w*|\\d+|[\\s\\v]+|[^\\w\\s\\v]')) AS n FROM documents WHERE type_fqn IS NOT NULL")(
    lambda c: c.table("documents").where("type_fqn IS NOT NULL").select("doc_id", F.size(S.type_tokens(F.col("type_fqn"))).cast("bigint").alias("n"))
)

# Parsers over the sources of types and over texts.
_files = lambda c: c.types.where("source IS NOT NULL").select(F.col("id").cast("string").alias("file"), F.col("source").alias("text"))
query("parse1_structs")(lambda c: listings.definitions(_files(c)).where("kind = 'Struct'").select(F.col("file").cast("int").alias("id"), "full_name", F.size("members").alias("members"), F.size("bases").alias("bases"), "alignment"))
query("parse3_members")(lambda c: listings.definitions(_files(c)).where("kind = 'Struct'").select(F.col("file").cast("int").alias("id"), F.explode("members").alias("m")).select("id", "m.name", "m.type_string", "m.decl_order", "m.bit_width", "m.is_array", "m.array_size", "m.pointer_depth", "m.is_function_pointer"))
query("parse6_unions")(lambda c: listings.definitions(_files(c)).where("kind = 'Union'").select(F.col("file").cast("int").alias("id"), "full_name", F.size("members").alias("members")))
query(
    "parse8_enum_members",
    """WITH b AS (SELECT id, regexp_extract(source, '\\{(.*)\\}', 1, 's') AS body FROM types WHERE kind = 'Enum' AND regexp_matches(source, '(?s)^/\\*\\s*\\d+\\s*\\*/\\r?\\nenum [^;{]*\\{.*\\}')),
m AS (SELECT id, unnest(string_split(body, ',')) AS part FROM b)
SELECT id, regexp_extract(part, '^\\s*([a-zA-Z_]\\w*)', 1) AS name, trim(regexp_extract(part, '(?s)=\\s*(.*?)\\s*$', 1)) AS value FROM m WHERE regexp_matches(part, '(?s)^\\s*([a-zA-Z_]\\w*)\\s*(?:=\\s*(.*?))?\\s*$')""",
)(lambda c: listings.definitions(_files(c)).where("kind = 'Enum'").select(F.col("file").cast("int").alias("id"), F.explode("values").alias("v")).join(c.types_of_kind("Enum").select("id"), "id", "left_semi").select("id", "v.name", "v.value"))
query("parse9_typedefs")(lambda c: listings.definitions(_files(c)).where("kind = 'Typedef'").select(F.col("file").cast("int").alias("id"), "name", "refers_to", "signature"))
query("parse10_functions")(lambda c: c.table("documents").select("doc_id", F.explode(listings.functions_of(F.col("text"))).alias("f")).select("doc_id", "f.name", "f.owner", "f.offset", "f.convention", "f.returns", F.size("f.parameters").alias("parameters")))
query("parse11_statics")(lambda c: c.table("documents").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line", "t")).select("doc_id", "line", F.explode(listings.statics_of(F.col("t"))).alias("s")).select("doc_id", "line", "s.address", "s.name", "s.type_string"))
query("parse13_signatures")(lambda c: c.bodies.select("id", listings.signature_of(F.col("fully_qualified_name")).alias("s")).select("id", "s.name", "s.convention", "s.returns", F.size("s.parameters").alias("parameters")))
query("parse15_member_names")(lambda c: c.types.select("id", F.array_join(listings.member_names_of(F.col("source")), ",").alias("names")))
query("g10_type_nodes")(lambda c: c.references.select("type_string").distinct().select("type_string", F.explode(listings.type_nodes_of(F.col("type_string"))).alias("n")).select("type_string", "n.path", "n.text", "n.base"))
query("r4_references")(lambda c: c.references.select("id", listings.references_of(F.col("type_string")).alias("r")).select("id", "r.*"))
query("w7_first_definitions")(lambda c: listings.first_definitions(listings.definitions(_files(c))).select("full_name", "kind", "file", F.size("members").alias("members")))

# Sources rendered as texts and read again: an independent check of the parsers at any size.
_n = lambda x: x.cast("string")
query("rt_structs", "SELECT 'Part_' || p_partkey AS full_name, 'Base_' || p_size AS base, 2 AS members, 'p_size' AS first_name, 'unsigned int' AS first_type FROM part")(
    lambda c: listings.definitions(
        c.table("part").select(_n(F.col("p_partkey")).alias("file"), F.concat(F.lit("/* 1 */\nstruct __cppobj Part_"), _n(F.col("p_partkey")), F.lit(" : Base_"), _n(F.col("p_size")), F.lit("\n{\n  unsigned int p_size; // bytes\n  const Name<int, Part *> *p_name[4];\n};\n")).alias("text"))
    ).select("full_name", F.col("bases")[0].alias("base"), F.size("members").alias("members"), F.col("members")[0]["name"].alias("first_name"), F.col("members")[0]["type_string"].alias("first_type"))
)
query("rt_enums", "SELECT 'Order_' || o_orderkey AS full_name, 'STATUS_' || o_orderstatus AS name, '0x' || lower(to_hex(o_custkey)) AS value FROM orders")(
    lambda c: listings.definitions(c.table("orders").select(_n(F.col("o_orderkey")).alias("file"), F.concat(F.lit("/* 7 */\nenum Order_"), _n(F.col("o_orderkey")), F.lit("\n{\n  STATUS_"), F.col("o_orderstatus"), F.lit(" = 0x"), F.lower(F.hex("o_custkey")), F.lit(",\n};\n")).alias("text"))).select("full_name", F.explode("values").alias("v")).select("full_name", "v.name", "v.value")
)
query("rt_functions", "SELECT 'Nation_' || s_nationkey || '::Supply_' || s_suppkey AS name, s_suppkey AS offset, '__thiscall' AS convention, 2 AS parameters FROM supplier")(
    lambda c: c.table("supplier")
    .select(F.explode(listings.functions_of(F.concat(F.lit("//----- ("), F.hex("s_suppkey"), F.lit(") ------\nint __thiscall Nation_"), _n(F.col("s_nationkey")), F.lit("::Supply_"), _n(F.col("s_suppkey")), F.lit("(\n  Nation *this,\n  Map<int,int> m)\n{\n  if ( m ) { return 1; }\n}\n")))).alias("f"))
    .select("f.name", "f.offset", "f.convention", F.size("f.parameters").alias("parameters"))
)
query("rt_statics", "SELECT lpad(upper(to_hex(c_custkey)), 16, '0') AS address, 'Nation_' || c_nationkey || '::s_' || c_custkey AS name, 'Map<int, Customer*>*' AS type_string FROM customer")(
    lambda c: c.table("customer").select(F.explode(listings.statics_of(F.concat(F.lpad(F.hex("c_custkey"), 16, "0"), F.lit(" public: static Map<int, Customer *> * Nation_"), _n(F.col("c_nationkey")), F.lit("::s_"), _n(F.col("c_custkey")), F.lit(" 8 bytes [statics]")))).alias("s")).select("s.address", "s.name", "s.type_string")
)

_k = lambda c="p_partkey": F.col(c).cast("string")
_MEMBERS_OF_PART = """[('flags', 'unsigned int', 3, false, NULL, 0, false), ('pad', '_BYTE', NULL, true, p_size, 0, false), ('next', 'const Name<int, Part_' || p_partkey || '*>*', NULL, false, NULL, 1, false),
('run', NULL, NULL, false, NULL, 0, true), ('grid', 'double*', NULL, true, 4, 1, false), ('m_' || p_partkey, 'N::Inner', NULL, false, NULL, 0, false)]"""
query(
    "rt_members",
    f"""SELECT 'N_' || p_size || '::Part_' || p_partkey AS full_name, u.i - 1 AS decl_order, m[u.i][1] AS name, m[u.i][2] AS type_string, m[u.i][3] AS bit_width, m[u.i][4] AS is_array, m[u.i][5] AS array_size, m[u.i][6] AS pointer_depth, m[u.i][7] AS is_function_pointer
FROM (SELECT *, {_MEMBERS_OF_PART} AS m FROM part), range(1, 7) u(i)""",
)(
    lambda c: listings.definitions(
        c.table("part").select(
            _k().alias("file"),
            F.concat(
                F.lit("/* 3 */\nstruct __cppobj N_"), _k("p_size"), F.lit("::Part_"), _k(), F.lit(" : Base_"), _k("p_size"), F.lit(", Other<int, Part_"), _k(), F.lit(" *>\n{\n  unsigned int flags : 3;\n  _BYTE pad["), _k("p_size"),
                F.lit("];\n  const Name<int, Part_"), _k(), F.lit(" *> *next; // note\n  void (__thiscall *run)(Part_"), _k(), F.lit(" *this, int);\n  double *grid[4];\n  N::Inner m_"), _k(), F.lit(";\n};\n"),
            ).alias("text"),
        )
    ).select("full_name", F.explode("members").alias("m")).select("full_name", "m.decl_order", "m.name", F.when(~F.col("m.is_function_pointer"), F.col("m.type_string")).alias("type_string"), "m.bit_width", "m.is_array", "m.array_size", "m.pointer_depth", "m.is_function_pointer")
)
query("rt_unions", "SELECT 'U_' || s_suppkey AS full_name, 2 AS members, 'b_' || s_nationkey AS last_name FROM supplier")(
    lambda c: listings.definitions(c.table("supplier").select(_k("s_suppkey").alias("file"), F.concat(F.lit("/* 9 */\nunion U_"), _k("s_suppkey"), F.lit("\n{\n  int a;\n  float b_"), _k("s_nationkey"), F.lit(";\n};\n")).alias("text")))
    .where("kind = 'Union'").select("full_name", F.size("members").alias("members"), F.element_at("members", -1)["name"].alias("last_name"))
)
query("rt_typedefs", "SELECT 'T_' || c_custkey AS name, 'N_' || c_nationkey || ' *' AS refers_to FROM customer")(
    lambda c: listings.definitions(c.table("customer").select(_k("c_custkey").alias("file"), F.concat(F.lit("/* 2 */\ntypedef N_"), _k("c_nationkey"), F.lit(" *T_"), _k("c_custkey"), F.lit(";\n")).alias("text"))).where("kind = 'Typedef'").select("name", "refers_to")
)
query("rt_signatures", "SELECT o_orderkey AS id, 'O_' || o_custkey || '::go_' || o_orderkey AS name, '__cdecl' AS convention, 'unsigned int' AS returns, 'a,cb,m' AS parameters FROM orders")(
    lambda c: c.table("orders").select(F.col("o_orderkey").alias("id"), listings.signature_of(F.concat(F.lit("unsigned int __cdecl O_"), _k("o_custkey"), F.lit("::go_"), _k("o_orderkey"), F.lit("(const A *a, void (__stdcall *cb)(int, B *), Map<int, C *> m)"))).alias("s"))
    .select("id", "s.name", "s.convention", "s.returns", F.array_join(F.transform("s.parameters", lambda p: p["name"]), ",").alias("parameters"))
)


def _built(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A catalog of structs whose layout is known: a struct per customer, which an order has by value, with a base, an array, bit fields and a pointer."""
    customers, orders = c.table("customer"), c.table("orders").select(F.col("o_orderkey").cast("int").alias("k"), F.col("o_custkey").cast("int").alias("cust"))
    none = F.lit(None).cast("int")
    named = lambda df, i, prefix: df.select(i.alias("id"), F.concat(F.lit(prefix), i.cast("string")).alias("base_name"), F.lit("Struct").alias("kind"), none.alias("alignment"), F.concat(F.lit(prefix), i.cast("string")).alias("stored_fully_qualified_name"))
    cust, order = F.col("c_custkey").cast("int"), F.col("k") + 50_000_000
    types = named(customers, cust, "C").unionByName(named(orders, order, "O"))
    part = lambda n, name, kind, ref=None, bits=None: F.struct(F.lit(n).alias("n"), F.lit(name).alias("name"), kind.alias("type_string"), (ref if ref is not None else none).alias("type_reference_id"), F.lit(bits).cast("int").alias("bit_width"))
    own = F.concat(F.lit("C"), F.col("cust").cast("string"))
    of_customer = customers.select(cust.alias("struct_id"), F.explode(F.array(part(0, "c", F.lit("char")), part(1, "i", F.lit("int")), part(2, "s", F.lit("short")))).alias("p"))
    of_order = orders.select(order.alias("struct_id"), F.explode(F.array(part(0, "f", F.lit("int"), bits=3), part(1, "g", F.lit("int"), bits=5), part(2, "one", own), part(3, "many", own, F.col("cust")), part(4, "d", F.lit("double")), part(5, "p", F.concat(own, F.lit(" *"))), part(6, "z", F.lit("char")))).alias("p"))
    members = of_customer.unionByName(of_order).select((F.col("struct_id").cast("long") * 8 + F.col("p.n")).alias("id"), "struct_id", "p.name", "p.type_string", "p.type_reference_id", F.col("p.n").alias("decl_order"), "p.bit_width", none.alias("alignment"), F.lit(False).alias("is_function_pointer"))
    references = customers.select(cust.alias("id"), F.concat(F.lit("C"), cust.cast("string"), F.lit("[3]")).alias("type_string"), cust.alias("referenced_type_id"), F.lit(False).alias("is_pointer"), F.lit(True).alias("is_array"), F.lit(3).alias("array_size"))
    bases = orders.select(F.col("k").alias("id"), order.alias("parent_type_id"), F.col("cust").alias("related_type_id"), F.lit(0).alias("ord"))
    return types, members.withColumn("id", F.col("id").cast("int")), references, bases


# A customer's struct has 12 bytes (1, to 4 + 4, + 2, to 12); an order's begins with one, then 4 + 4 for the bit fields in its size, which takes no notice of packing, but 4 in its offsets.
query("rt_type_sizes", "SELECT c_custkey::INT AS id, 12 AS size FROM customer UNION ALL SELECT o_orderkey::INT + 50000000, 12 + 8 + 12 + 36 + 8 + 4 + 4 FROM orders")(lambda c: layout.type_sizes(*_built(c)).select("id", F.col("size").cast("int").alias("size")))
query(
    "rt_member_offsets",
    """SELECT c_custkey::INT AS struct_id, name, pos AS member_offset FROM customer, (VALUES ('c', 0), ('i', 4), ('s', 8)) v(name, pos)
UNION ALL SELECT o_orderkey::INT + 50000000, name, pos FROM orders, (VALUES ('f', 12), ('g', 12), ('one', 16), ('many', 28), ('d', 64), ('p', 72), ('z', 76)) v(name, pos)""",
)(lambda c: layout.member_offsets(*(b := _built(c))).join(b[1].select("id", "name"), "id").select("struct_id", "name", F.col("member_offset").cast("int").alias("member_offset")))

# Layout, texts, pipeline, changes.
query("y2_member_offsets")(lambda c: layout.member_offsets(c.types, c.members, c.references, c.bases))
query("y4_type_sizes")(lambda c: layout.type_sizes(c.types, c.members, c.references, c.bases))
query("y7_primitive_sizes", f"SELECT name, CASE lower(name) {' '.join(f'''WHEN '{k.lower()}' THEN {v}''' for k, v in PRIMITIVE_SIZES.items())} ELSE 4 END AS size FROM primitive_types")(lambda c: c.table("primitive_types").select("name", S.primitive_size(F.col("name")).alias("size")))
query("y10_aligned", "SELECT l_orderkey, l_linenumber, (l_linenumber * 3 + (8 - (l_linenumber * 3) % 8) % 8)::INT AS aligned FROM lineitem")(lambda c: c.table("lineitem").select("l_orderkey", "l_linenumber", layout.align_up(F.col("l_linenumber") * 3, F.lit(8)).cast("int").alias("aligned")))
_full = lambda: F.coalesce("stored_fully_qualified_name", "base_name").alias("full_name")


def _plain_members(c: Catalog) -> DataFrame:
    """Members as texts take them (see :func:`render.member_text`): arrays by their references, pointers to functions by their types."""
    refs = c.references.select(F.col("id").alias("type_reference_id"), F.coalesce("is_array", F.lit(False)).alias("_array"), "array_size").dropDuplicates(["type_reference_id"])
    rows = c.members.where("struct_id IS NOT NULL").join(refs, "type_reference_id", "left").withColumn("is_array", F.coalesce("_array", F.lit(False)) & ~F.coalesce("is_function_pointer", F.lit(False)))
    rows = rows.withColumn("_p", listings.pointer_of(F.when(F.col("is_function_pointer"), F.col("type_string"))))
    kind = F.when(F.col("is_array"), S.trimmed(F.regexp_replace("type_string", r"^([^\[]*)\[\d*\]", "$1"))).otherwise(F.coalesce("_p.returns", "type_string"))
    return rows.select("struct_id", "id", "decl_order", "name", kind.alias("type_string"), "is_array", "array_size", "bit_width", "is_function_pointer", F.coalesce("_p.parameters", F.lit("")).alias("parameters"), F.coalesce("_p.convention", F.lit("")).alias("convention"), "member_offset")


query("c3_struct_texts")(lambda c: render.struct_texts(c.types.where("kind IN ('Struct', 'Class', 'Union')").select("id", _full(), "source", "alignment"), _plain_members(c), c.bases))
query("c1_headers")(lambda c: render.headers(rules.grouped(c.types, rules.locations(c.types)), QUERIES["c3_struct_texts"](c.spark, c.directory).unionByName(QUERIES["c2_enum_texts"](c.spark, c.directory))))
_enum_values = lambda c: listings.definitions(_files(c).where(F.contains("text", F.lit("enum")))).where("kind = 'Enum'").select(F.col("file").cast("int").alias("enum_id"), F.posexplode("values").alias("position", "v")).select("enum_id", "position", "v.name", "v.value")
query("c2_enum_texts")(lambda c: render.enum_texts(c.types_of_kind("Enum").select("id", _full(), "is_bitmask"), _enum_values(c)))
query("a7_enum_widths")(lambda c: render.enum_widths(_enum_values(c)))
query("c7_bindings")(lambda c: render.binding_texts(c.types, _plain_members(c), c.bases, _enum_values(c)))
query("c6_namespaces")(lambda c: render.namespaces(c.types, QUERIES["c7_bindings"](c.spark, c.directory)))


def _events(c: Catalog) -> DataFrame:
    """Events as results of a pipeline."""
    e = c.table("events")
    return e.select(
        F.lit("s").alias("stage"), F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("full_name"), F.when(F.col("value") > 50, "Success").otherwise("Failed").alias("status"), F.lit(None).cast("string").alias("content"),
        F.pmod("event_id", F.lit(4)).cast("int").alias("retries"), F.col("event_id").alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), F.pmod("event_id", F.lit(1000)).alias("llm_ms"), (F.pmod("event_id", F.lit(3)) == 0).alias("cache_hit"),
    )


query(
    "a6_statistics",
    """SELECT count(*) AS total, count(*) FILTER (value > 50) AS succeeded, count(*) FILTER (NOT value > 50 OR value IS NULL) AS failed, sum(event_id % 4)::BIGINT AS retries, count(*) FILTER (event_id % 3 = 0) AS cache_hits,
count(*) FILTER (event_id % 3 = 0) / count(*) AS hit_rate, (sum(event_id % 1000) FILTER (event_id % 3 <> 0))::BIGINT AS llm_ms, (sum(event_id % 1000) FILTER (event_id % 3 <> 0)) / (count(*) FILTER (event_id % 3 <> 0)) AS mean_ms,
sum(event_id)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS completion_tokens FROM events""",
)(lambda c: pipeline.statistics(_events(c)))
query("k5_upsert", "SELECT user_id, CASE WHEN count(*) FILTER (event_id % 2 = 1) > 0 THEN max(event_id) FILTER (event_id % 2 = 1) ELSE max(event_id) END AS event_id FROM events GROUP BY 1")(
    lambda c: K.upsert(c.table("events").where("event_id % 2 = 0").select("user_id", "event_id"), c.table("events").where("event_id % 2 = 1").select("user_id", "event_id"), ["user_id"], F.col("event_id"))
)
_PARTS = r"""b AS (SELECT id, regexp_extract(source, '\{(.*)\}', 1, 's') AS body FROM types WHERE regexp_matches(source, '(?s)^/\*\s*\d+\s*\*/\r?\nenum [^;{]*\{.*\}')),
m AS (SELECT id, unnest(string_split(body, ',')) AS part, generate_subscripts(string_split(body, ','), 1) AS n FROM b),
v AS (SELECT id, n, regexp_extract(part, '^\s*([a-zA-Z_]\w*)', 1) AS name, trim(regexp_extract(part, '(?s)=\s*(.*?)\s*$', 1)) AS value FROM m WHERE regexp_matches(part, '(?s)^\s*([a-zA-Z_]\w*)\s*(?:=\s*(.*?))?\s*$'))"""
ORACLES["c2_enum_texts"] = f"""WITH {_PARTS}, l AS (SELECT id, string_agg(chr(10) || '    ' || name || CASE WHEN value <> '' THEN ' = ' || value ELSE '' END || ',', '' ORDER BY n) AS t FROM v GROUP BY id)
SELECT types.id, 'enum ' || CASE WHEN is_bitmask THEN '__bitmask ' ELSE '' END || coalesce(stored_fully_qualified_name, base_name) || chr(10) || '{{' || coalesce(t, '') || chr(10) || '}};' AS content FROM types LEFT JOIN l USING (id) WHERE kind = 'Enum'"""
ORACLES["a7_enum_widths"] = f"""WITH {_PARTS}, num AS (SELECT id, CASE WHEN regexp_matches(value, '^-?0[xX][0-9a-fA-F]{{1,15}}[LlUu]*$') THEN (CASE WHEN value LIKE '-%' THEN -1 ELSE 1 END) * ('0x' || regexp_extract(value, '^-?0[xX]([0-9a-fA-F]+)', 1))::BIGINT
  WHEN regexp_matches(value, '^[-+]?\\d+[LlUu]*$') THEN TRY_CAST(rtrim(value, 'LlUu') AS BIGINT) END AS x FROM v),
lh AS (SELECT id, least(coalesce(min(x), 0), 0) AS low, greatest(coalesce(max(x), 0), 0) AS high FROM num GROUP BY id)
SELECT id AS enum_id, CASE WHEN low < 0 THEN CASE WHEN low >= -128 AND high <= 127 THEN 'sbyte' WHEN low >= -32768 AND high <= 32767 THEN 'short' WHEN low >= -2147483648 AND high <= 2147483647 THEN 'int' ELSE 'long' END
  WHEN high >= 2147483647 THEN 'uint' WHEN high <= 255 THEN 'byte' WHEN high <= 65535 THEN 'ushort' ELSE 'uint' END AS width FROM lh"""
_stage = pipeline.Stage("CommentEnums", "Write a summary.", pipeline.stub_checker, pipeline.stub_writer)
query("e2_stage", "SELECT 'CommentEnums' AS stage, 'Enum' AS entity_type, coalesce(stored_fully_qualified_name, base_name, 'Unknown') AS full_name, 'Success' AS status FROM types WHERE NOT is_ignored AND kind = 'Enum'")(
    lambda c: pipeline.run_stage(c.work_items(("Enum",)).withColumn("target", F.col("full_name")), c.spark.createDataFrame([], pipeline.RESULTS), _stage)[0].select("stage", "entity_type", "full_name", "status")
)
query("d_update_path", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 'moved' END, base_type_path) AS base_type_path FROM types")(lambda c: K.update(c.types, c.types.where("id % 2 = 0").select("id", F.lit("moved").alias("base_type_path"))).select("id", "base_type_path"))
query("d_delete_members", f"SELECT id FROM {MEMBERS} WHERE struct_id NOT IN (SELECT id FROM types WHERE namespace = 'Net') OR struct_id IS NULL")(lambda c: K.delete(c.members, c.types_in("Net").select("id"), "struct_id").select("id"))
query("d_insert_types", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")(lambda c: K.insert(c.table("nation").select(F.col("n_name").alias("name")), c.table("region").select(F.col("r_name").alias("name")), "name"))

# Functions as members.
_signed = lambda c: methods.signatures(c.bodies)
query("f21_function_kinds")(lambda c: methods.kinds(_signed(c), c.types))
query("c9_method_texts")(lambda c: methods.method_texts(_signed(c)))
query("j29_function_contexts")(lambda c: methods.contexts(_signed(c), c.types, c.bases))
query(
    "j23_slot_bodies",
    f"""WITH t AS (SELECT id, base_name, coalesce(namespace, '') AS ns FROM types), p AS (SELECT base_name, ns, min(id) AS parent_id FROM t GROUP BY ALL),
s AS (SELECT m.id AS member_id, m.name, parent_id FROM {MEMBERS} m JOIN t ON t.id = m.struct_id JOIN p ON p.ns = t.ns AND p.base_name = regexp_replace(t.base_name, '_vtbl$', '') WHERE ends_with(t.base_name, '_vtbl')),
b AS (SELECT id, parent_id, list_last(string_split(regexp_extract(fully_qualified_name, '([\\w:~]+)\\(', 1), '::')) AS name FROM {BODIES} WHERE length(fully_qualified_name) > 0)
SELECT member_id, min(b.id) AS body_id FROM s JOIN b ON b.parent_id = s.parent_id AND b.name = s.name GROUP BY 1""",
)(lambda c: methods.slot_bodies(c.types, c.members, _signed(c)))
query("g9_nested_flat", ORACLES["j25_nested_types"].replace("WITH t AS", "WITH RECURSIVE t AS").replace("SELECT parent_id, l.id AS child_id", ", direct AS (SELECT parent_id, l.id AS child_id") + "), flat AS (SELECT child_id AS c, parent_id AS p FROM direct UNION SELECT f.c, d.parent_id FROM flat f JOIN direct d ON d.child_id = f.p) SELECT c AS child, p AS parent FROM flat")(lambda c: graph.closure(resolution.nested_types(c.types).select(F.col("child_id").cast("long").alias("child"), F.col("parent_id").cast("long").alias("parent"))))
_DECLARED = "regexp_extract(line, '^(.*[\\s*&>\\]])\\w+;$', 1)"
query("x6_types_of_declarations", f"SELECT DISTINCT line, {NORM(_DECLARED)} AS type FROM (SELECT trim(unnest(regexp_split_to_array(source, '\\r?\\n'))) AS line FROM types) WHERE regexp_matches(line, '^[\\w:]+[ *]+\\w+;$')")(
    lambda c: c.types.select(F.explode(F.split("source", r"\r?\n")).alias("l")).select(F.trim("l").alias("line")).where(F.col("line").rlike(r"^[\w:]+[ *]+\w+;$")).distinct().select("line", S.normalize_type(F.regexp_extract("line", r"^(.*[\s*&>\]])\w+;$", 1)).alias("type"))
)
