"""Names to ids: fallback chains of lookups, chains of typedefs, scopes, roots and nesting.

A chain of lookups is a chain of left joins against one row per key, coalesced in order.  Only distinct names are looked up, so
popular ones cost one row each; the answers go back to the rows through a join whose hot names are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.plans.shared import cut, hot_keys, join_to_keys


def ids_by_name(types: DataFrame) -> DataFrame:
    """name, type_id: the smallest id of each stored name."""
    named = types.where(F.length("stored_fully_qualified_name") > 0)
    return named.groupBy(F.col("stored_fully_qualified_name").alias("name")).agg(F.min("id").alias("type_id"))


def reference_ids(rows: DataFrame, references: DataFrame) -> DataFrame:
    """``rows`` with ref: the first reference of the same type string."""
    first = references.where("type_string IS NOT NULL").groupBy("type_string").agg(F.min("id").alias("ref"))
    hot = hot_keys(rows.groupBy("type_string").agg(F.count(F.lit(1)).alias("n")), "type_string", "n")
    return join_to_keys(rows, first, "type_string", "id", hot, "left", merge=False)


def typedef_targets(typedefs: DataFrame, types: DataFrame) -> DataFrame:
    """name, type_id, depth: what the chain of typedefs of each name ends on.

    ``typedefs`` has name, namespace and type_string.  Typedefs without a namespace come first, then the smallest id.  Names
    whose chain runs in a circle, or ends on a name that is neither a type nor a typedef, have a null type_id.  Each round
    doubles the links followed; a circle is what is still open after as many links as there are names.
    """
    own = typedefs.groupBy("name").agg(F.min_by("type_string", F.struct(F.col("namespace") != "", "id")).alias("to"))
    bare = S.trimmed(F.regexp_replace(F.regexp_replace(S.trimmed(F.col("to")), r"[*&\s]+$", ""), "^const ", ""))
    links = cut(own.select("name", bare.alias("to")).withColumn("base", S.base_type_name(F.col("to"))))
    named = ids_by_name(types)
    full, short = named.select(F.col("name").alias("to"), F.col("type_id").alias("_a")), named.select(F.col("name").alias("base"), F.col("type_id").alias("_b"))
    jump = cut(links.join(full, "to", "left").join(short, "base", "left").select("name", F.col("base").alias("at"), F.coalesce("_a", "_b").alias("type_id"), F.lit(1).alias("depth")))
    for _ in range(links.count().bit_length() + 1):
        still = jump.where("type_id IS NULL").select("name", "at", "depth")
        if not still.take(1):
            break
        on = jump.select(F.col("name").alias("at"), F.col("at").alias("_at"), "type_id", F.col("depth").alias("_d"))
        moved = still.join(on, "at").select("name", F.col("_at").alias("at"), "type_id", (F.col("depth") + F.col("_d")).alias("depth"))
        jump = cut(jump.where("type_id IS NOT NULL").unionByName(moved))
    return links.select("name").join(jump.where("type_id IS NOT NULL").select("name", "type_id", "depth"), "name", "left")


def resolve_names(names: DataFrame, types: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """text, type_id, step of distinct texts (text, full): the first of the lookups that finds a type, and which one it was.

    1 the full name, 2 typedefs of it, 3 the base name, 4 typedefs of that, 5 the normalized base name, 6 the base name of that.
    Primitive types aren't looked up.
    """
    named = ids_by_name(types)
    asked = names.where(~S.is_primitive(F.col("text"))).select("text", "full").distinct()
    base = S.base_type_name(F.col("text"))
    steps: list[tuple[int, Column, DataFrame]] = [(1, F.col("full"), named), (3, base, named), (5, S.normalize_type(base), named), (6, S.base_type_name(S.normalize_type(base)), named)]
    if targets is not None:
        chains = targets.where("type_id IS NOT NULL").select("name", "type_id")
        steps += [(2, F.col("full"), chains), (4, base, chains)]
    for n, key, table in sorted(steps, key=lambda s: s[0]):
        asked = asked.withColumn(f"_k{n}", key).join(table.select(F.col("name").alias(f"_k{n}"), F.col("type_id").alias(f"_t{n}")), f"_k{n}", "left")
    order = sorted(n for n, _, _ in steps)
    found = [F.col(f"_t{n}") for n in order]
    step = F.coalesce(*[F.when(F.col(f"_t{n}").isNotNull(), n) for n in order])
    return asked.select("text", "full", F.coalesce(*found).alias("type_id"), step.alias("step"))


def resolve_references(references: DataFrame, types: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``references`` with referenced_type_id filled in where it was null and a lookup finds a type."""
    want = references.where("referenced_type_id IS NULL AND length(type_string) > 0")
    full = F.coalesce("fully_qualified_type", F.lit(""))
    answers = resolve_names(want.select(F.col("type_string").alias("text"), full.alias("full")), types, targets).where("type_id IS NOT NULL")
    key = lambda a, b: F.concat_ws("\u0001", a, b)
    per_key = answers.select(key(F.col("text"), F.col("full")).alias("_key"), F.col("type_id").alias("_found"))
    rows = references.withColumn("_key", F.when(F.col("referenced_type_id").isNull(), key(F.col("type_string"), full)))
    hot = hot_keys(rows.where("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", "n")
    joined = join_to_keys(rows, per_key, "_key", "id", hot, "left")
    return joined.withColumn("referenced_type_id", F.coalesce("referenced_type_id", "_found")).drop("_key", "_found").select(*references.columns)


def resolve_bases(bases: DataFrame, types: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``bases`` with related_type_id filled in: the string, typedefs of it, the normalized string."""
    named = ids_by_name(types)
    text = F.when(F.col("related_type_id").isNull() & (F.length("related_type_string") > 0) & ~S.is_primitive(F.col("related_type_string")), F.col("related_type_string"))
    rows = bases.withColumn("_a", text).withColumn("_b", S.normalize_type(F.col("_a")))
    found = rows.join(named.select(F.col("name").alias("_a"), F.col("type_id").alias("_t1")), "_a", "left").join(named.select(F.col("name").alias("_b"), F.col("type_id").alias("_t3")), "_b", "left")
    second = F.lit(None).cast("int")
    if targets is not None:
        found = found.join(targets.where("type_id IS NOT NULL").select(F.col("name").alias("_a"), F.col("type_id").alias("_t2")), "_a", "left")
        second = F.col("_t2")
    return found.withColumn("related_type_id", F.coalesce("related_type_id", "_t1", second, "_t3")).select(*bases.columns)


def register_arguments(arguments: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arguments with type_reference_id, references to add): strings that have no reference yet get one, numbered after the last."""
    text = S.normalize_type(F.col("type_string"))
    known = references.where("type_string IS NOT NULL").groupBy("type_string").agg(F.min("id").alias("type_reference_id"))
    want = arguments.where(~S.is_primitive(F.col("type_string")) & (F.length(text) > 0)).select(text.alias("type_string")).distinct()
    missing = want.join(known, "type_string", "left_anti")
    from orrery.plans.shared import row_numbers

    last = references.agg(F.max("id")).first()[0] or 0
    added = row_numbers(missing, ["type_string"], "id").select((F.col("id") + last).alias("id"), "type_string")
    every = known.unionByName(added.select("type_string", F.col("id").alias("type_reference_id")))
    done = arguments.withColumn("_text", F.when(~S.is_primitive(F.col("type_string")), text)).join(every.withColumnRenamed("type_string", "_text"), "_text", "left").drop("_text")
    return done, added


def typedef_by_name(typedefs: DataFrame, names: DataFrame) -> DataFrame:
    """text, id of the typedef each name (text) stands for: with ``::`` exactly, else without a namespace first, then any."""
    at = F.length("text") - F.length(F.substring_index("text", "::", -1)) - 2
    asked = names.select("text").distinct().withColumn("_ns", F.when(F.contains("text", F.lit("::")), F.expr("substring(text, 1, length(text) - length(substring_index(text, '::', -1)) - 2)")))
    asked = asked.withColumn("_name", F.substring_index("text", "::", -1))
    own = typedefs.select(F.col("name").alias("_name"), F.coalesce("namespace", F.lit("")).alias("_own"), F.col("id").alias("_id"))
    hits = asked.join(own, "_name").where(F.col("_ns").isNull() | (F.col("_ns") == F.col("_own")))
    return hits.groupBy("text").agg(F.min_by("_id", F.struct(F.col("_own") != "", "_id")).alias("id"))


def in_scope(names: DataFrame, types: DataFrame) -> DataFrame:
    """name, scope, type_id of identifiers seen from a namespace: as it stands, then from the innermost scope outward, then by base name."""
    named = ids_by_name(types)
    asked = names.select("name", F.coalesce("scope", F.lit("")).alias("scope")).distinct()
    tries = F.concat(F.array(F.col("name")), F.transform(S.scopes(F.col("scope")), lambda s: F.concat(s, F.lit("::"), F.col("name"))))
    ladder = asked.select("name", "scope", F.posexplode(tries).alias("step", "full")).join(named.withColumnRenamed("name", "full"), "full")
    best = ladder.groupBy("name", "scope").agg(F.min_by("type_id", "step").alias("_scoped"))
    bare = types.groupBy(F.col("base_name").alias("name")).agg(F.min("id").alias("_bare"))
    return asked.join(best, ["name", "scope"], "left").join(bare, "name", "left").select("name", "scope", F.coalesce("_scoped", "_bare").alias("type_id"))


def owners(functions: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """``functions`` with parent_id: the type named by what stands before the last ``::``."""
    owner = F.when(F.contains(F.col(name), F.lit("::")), F.expr(f"substring({name}, 1, length({name}) - length(substring_index({name}, '::', -1)) - 2)"))
    named = ids_by_name(types).select(F.col("name").alias("_owner"), F.col("type_id").alias("parent_id"))
    return functions.withColumn("_owner", owner).join(named, "_owner", "left").drop("_owner")


def static_owners(statics: DataFrame, types: DataFrame) -> DataFrame:
    """``statics`` with parent_id; where there is an owner, the short name takes the place of the full one."""
    found = owners(statics, types)
    return found.withColumn("name", F.when(F.col("parent_id").isNotNull(), F.substring_index("name", "::", -1)).otherwise(F.col("name")))


def static_definitions(statics: DataFrame, lines: DataFrame) -> DataFrame:
    """name, file, line of the first source line that defines each static: not indented, with ``=``, its last word before that the
    bare name, and the full name in it."""
    assigned = lines.where(~F.col("text").rlike(r"^\s") & F.col("text").rlike("^[^=]+="))
    keyed = assigned.withColumn("_key", F.regexp_extract(F.regexp_extract("text", "^([^=]+)=", 1), r"(\w+)\s*$", 1)).where("_key <> ''")
    wanted = statics.select("name").distinct().withColumn("_key", F.substring_index("name", "::", -1))
    hits = wanted.join(keyed, "_key").where(F.contains("text", "name"))
    return hits.groupBy("name").agg(F.min_by(F.struct("file", "line", "text"), F.struct("file", "line")).alias("f")).select("name", "f.*")


def nested_types(types: DataFrame) -> DataFrame:
    """parent_id, child_id, rank: tables of virtual functions under their type, types whose namespace is a type under that; tables first."""
    rows = types.select("id", "base_name", F.coalesce("namespace", F.lit("")).alias("namespace"), "is_vtable")
    table_of = F.endswith("base_name", F.lit("_vtbl"))
    by_base = rows.groupBy("base_name", "namespace").agg(F.min("id").alias("parent_id"))
    first = rows.where(table_of).withColumn("_b", F.regexp_replace("base_name", "_vtbl$", ""))
    tables = first.join(by_base.withColumnsRenamed({"base_name": "_b"}), ["_b", "namespace"])
    named = ids_by_name(types).select(F.col("name").alias("namespace"), F.col("type_id").alias("parent_id"))
    inner = rows.where(~table_of & (F.length("namespace") > 0)).join(named, "namespace")
    links = tables.select("id", "base_name", "parent_id", F.lit(0).alias("_r")).unionByName(inner.select("id", "base_name", "parent_id", F.when(F.col("is_vtable"), 0).otherwise(1).alias("_r")))
    parents = rows.select(F.col("id").alias("parent_id"), F.col("base_name").alias("_parent")).dropDuplicates(["parent_id"])
    links = links.join(parents, "parent_id").where("id <> parent_id AND base_name <> _parent")
    from pyspark.sql.window import Window as W

    return links.withColumn("rank", F.row_number().over(W.partitionBy("parent_id").orderBy("_r", "base_name", "id"))).select("parent_id", F.col("id").alias("child_id"), "rank")


def enclosing_types(types: DataFrame) -> DataFrame:
    """id, parent_id: the type that the longest enclosing namespace of a type names, or null."""
    named = ids_by_name(types).select(F.col("name").alias("scope"), F.col("type_id").alias("parent_id"))
    tries = types.select("id", F.posexplode(S.scopes(F.coalesce("namespace", F.lit("")))).alias("step", "scope")).join(named, "scope").where("id <> parent_id")
    best = tries.groupBy("id").agg(F.min_by("parent_id", "step").alias("parent_id"))
    return types.select("id").join(best, "id", "left")


def base_paths(types: DataFrame) -> DataFrame:
    """id, base_type_path: the name of the type that a type is filed under, by a ladder of rules.

    A table of virtual functions goes where its type goes; a type in nested namespaces to the type its first segment names; one in
    a plain namespace that is a type, there; else to itself.
    """
    rows = types.select("id", "base_name", F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("stored_fully_qualified_name", F.lit("")).alias("full"))
    by_name = rows.where("full <> ''").groupBy(F.col("full").alias("_k")).agg(F.min(F.struct("id", "full"))["full"].alias("_v"))
    by_base = rows.groupBy("base_name", "namespace").agg(F.min(F.struct("id", "full"))["full"].alias("_v"))
    top = by_base.where("namespace = ''").select(F.col("base_name").alias("_k"), "_v")

    def look(df: DataFrame, key: Column, table: DataFrame, out: str) -> DataFrame:
        return df.withColumn("_k", key).join(table.withColumnRenamed("_v", out), "_k", "left").drop("_k")

    first = lambda c: F.substring_index(c, "::", 1)
    table_of = F.endswith("base_name", F.lit("_vtbl"))
    parents = by_base.select(F.col("base_name").alias("_b"), F.col("namespace").alias("_n"), F.col("_v").alias("_parent"))
    out = rows.withColumn("_b", F.when(table_of, F.regexp_replace("base_name", "_vtbl$", ""))).withColumn("_n", F.col("namespace")).join(parents, ["_b", "_n"], "left")
    # The root of a type filed by name: the type its first segment names, if its name has several, else itself.
    out = look(out, F.when(F.contains("_parent", F.lit("::")), first("_parent")), top, "_p1")
    out = look(out, F.when(F.contains("_parent", F.lit("::")), first("_parent")), by_name, "_p2")
    out = look(out, F.when(F.contains("namespace", F.lit("::")), first("namespace")), top, "_s1")
    out = look(out, F.when(F.contains("namespace", F.lit("::")), first("namespace")), by_name, "_s2")
    out = look(out, F.when(F.col("namespace") != "", F.col("namespace")), by_name, "_same")
    out = look(out, F.when(F.contains("base_name", F.lit("::")), first("base_name")), by_name, "_o1")
    out = look(out, F.when(F.contains("base_name", F.lit("::")), first("base_name")), top, "_o2")
    filed = F.when(F.col("_parent").isNotNull(), F.coalesce("_p1", "_p2", "_parent"))
    return out.select("id", F.coalesce(filed, "_s1", "_s2", "_same", "_o1", "_o2", "full").alias("base_type_path"))


def grouping_roots(types: DataFrame) -> DataFrame:
    """id, root_id: up the chain of base_type_path to a type without one or that names itself; null where the chain breaks or turns back.

    Each step looks for the full name, then the base name in the same namespace, then the base name anywhere.  Each round doubles the
    steps climbed; what is still open after as many steps as there are links turns back.
    """
    rows = types.select("id", "base_name", F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("stored_fully_qualified_name", F.lit("")).alias("full"), F.coalesce("base_type_path", F.lit("")).alias("path"))
    target = S.base_type_name(F.col("path"))
    pathed = rows.where("path <> ''").withColumn("_t", target)
    one = ids_by_name(types).select(F.col("name").alias("path"), F.col("type_id").alias("_a"))
    two = rows.groupBy(F.col("base_name").alias("_t"), "namespace").agg(F.min("id").alias("_b"))
    three = rows.groupBy(F.col("base_name").alias("_t")).agg(F.min("id").alias("_c"))
    up = pathed.join(one, "path", "left").join(two, ["_t", "namespace"], "left").join(three, "_t", "left").select("id", F.coalesce("_a", "_b", "_c").alias("up"))
    is_root = (F.col("path") == "") | (F.col("path") == F.col("full")) | (target == F.col("base_name"))
    links = cut(up.join(rows.select(F.col("id").alias("up"), is_root.alias("_root")).dropDuplicates(["up"]), "up").select("id", "up", "_root").dropDuplicates(["id"]))
    jump = links
    for _ in range(links.count().bit_length() + 1):
        still = jump.where("NOT _root").select("id", "up")
        if not still.take(1):
            break
        on = jump.select(F.col("id").alias("up"), F.col("up").alias("_up"), "_root")
        jump = cut(jump.where("_root").unionByName(still.join(on, "up").select("id", F.col("_up").alias("up"), "_root")))
    return types.select("id").join(jump.where("_root").select("id", F.col("up").alias("root_id")), "id", "left")


def provenance(catalog, n: int | None = None) -> DataFrame:
    """id, text, used_as, user_id, user_name: every unresolved reference with the members that use it, or once without a user."""
    from orrery.operators.catalog import Catalog

    assert isinstance(catalog, Catalog)
    open_refs = catalog.references.where(F.col("referenced_type_id").isNull() & (F.length("type_string") > 0) & ~S.is_primitive(F.col("type_string"))).select("id", F.col("type_string").alias("text"))
    members = catalog.members.select(F.col("type_reference_id").alias("id"), F.col("struct_id").alias("user_id"), F.col("name").alias("user_name")).where("id IS NOT NULL")
    by_string = catalog.bases.select(F.col("related_type_string").alias("text"), F.col("parent_type_id").alias("user_id"))
    used = open_refs.join(members, "id").select("id", "text", F.lit("Member").alias("used_as"), "user_id", "user_name")
    base = open_refs.join(by_string, "text").select("id", "text", F.lit("Inheritance").alias("used_as"), "user_id", F.lit(None).cast("string").alias("user_name"))
    every = used.unionByName(base)
    alone = open_refs.join(every.select("id").distinct(), "id", "left_anti").select("id", "text", F.lit("TypeReference").alias("used_as"), F.lit(None).cast("int").alias("user_id"), F.lit(None).cast("string").alias("user_name"))
    out = every.unionByName(alone)
    return out if n is None else out.orderBy("id", "used_as", "user_id", "user_name").limit(n)
