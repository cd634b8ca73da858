"""Functions as members of types: what each one is, the slot of a table of virtual functions it fills, its text in the target language,
and the types one has to know to read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.functions.target import mapped
from orrery.sources.listings import signature_of


def signatures(bodies: DataFrame, text: str = "fully_qualified_name") -> DataFrame:
    """id, parent_id, body_offset, scoped, name, returns, convention, parameters of functions whose signature can be read."""
    read = bodies.where(F.length(text) > 0).select("id", "parent_id", "body_offset", signature_of(F.col(text)).alias("s")).where("s IS NOT NULL")
    return read.select("id", "parent_id", "body_offset", F.col("s.name").alias("scoped"), F.substring_index("s.name", "::", -1).alias("name"), "s.returns", "s.convention", "s.parameters")


def kinds(functions: DataFrame, types: DataFrame) -> DataFrame:
    """id, is_destructor, is_constructor, has_this of functions (see :func:`signatures`) that belong to a type.

    A destructor is ``~`` and the type's name, a constructor the name itself; any pointer in the first place counts as ``this``.
    """
    owner = types.select(F.col("id").alias("parent_id"), F.regexp_replace("base_name", "<.*$", "").alias("_base")).dropDuplicates(["parent_id"])
    bare = F.regexp_replace("name", "<.*$", "")
    first = F.get("parameters", 0)
    this = F.coalesce((first["name"] == "this") | (first["pointer_depth"] > 0), F.lit(False))
    return functions.join(owner, "parent_id").select("id", (bare == F.concat(F.lit("~"), "_base")).alias("is_destructor"), (bare == F.col("_base")).alias("is_constructor"), this.alias("has_this"))


def slot_bodies(types: DataFrame, members: DataFrame, functions: DataFrame) -> DataFrame:
    """member_id, body_id: for each slot of a table of virtual functions the first function of its type that has the slot's name."""
    rows = types.select("id", "base_name", F.coalesce("namespace", F.lit("")).alias("namespace"))
    plain = rows.groupBy("base_name", "namespace").agg(F.min("id").alias("parent_id"))
    tables = rows.where(F.endswith("base_name", F.lit("_vtbl"))).select(F.col("id").alias("struct_id"), F.regexp_replace("base_name", "_vtbl$", "").alias("base_name"), "namespace").join(plain, ["base_name", "namespace"])
    slots = members.join(tables, "struct_id").select(F.col("id").alias("member_id"), "name", "parent_id")
    return slots.join(functions.select("parent_id", "name", F.col("id").alias("_b")), ["parent_id", "name"]).groupBy("member_id").agg(F.min("_b").alias("body_id"))


def method_texts(functions: DataFrame, space: str = "Bindings") -> DataFrame:
    """id, content: each function with an address as a call through that address; names that can't be kept are commented out."""
    one = functions.where("body_offset IS NOT NULL").select("id", "name", "returns", "convention", "scoped", F.hex("body_offset").alias("_at"), F.posexplode_outer("parameters").alias("_k", "_p"))
    typed = one.select("*", mapped(F.col("_p.type"), None, space).alias("_t"), S.sanitize(F.col("_p.name")).alias("_n"), mapped(F.col("returns"), None, space).alias("_r"))
    listed = typed.groupBy("id", "name", "convention", "scoped", "_at", "_r").agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_t", "_n")))).alias("_l"))
    types = F.concat(F.transform("_l", lambda x: x["_t"]), F.array("_r"))
    shown = F.array_join(F.transform("_l", lambda x: F.concat_ws(" ", x["_t"], x["_n"])), ", ")
    text = F.concat(
        F.lit("public static "), F.col("_r"), F.lit(" "), S.sanitize(F.replace("name", F.lit("~"), F.lit("Destructor"))), F.lit("("), shown, F.lit(") => ((delegate* unmanaged["), S.calling_convention(F.col("convention")),
        F.lit("]<"), F.array_join(types, ", "), F.lit(">)"), S.address(F.col("_at")), F.lit(")("), F.array_join(F.transform("_l", lambda x: x["_n"]), ", "), F.lit(");"),
    )
    hidden = F.contains("scoped", F.lit("__userpurge")) | F.contains("scoped", F.lit("operator*"))
    return listed.select("id", F.when(hidden, F.concat(F.lit("// "), text)).otherwise(text).alias("content"))


def contexts(functions: DataFrame, types: DataFrame, bases: DataFrame) -> DataFrame:
    """id, section, type_id: the types of a function's owner, parameters and result, then the bases of these; each type once, in its
    first section."""
    named = types.where(F.length("stored_fully_qualified_name") > 0).groupBy(F.col("stored_fully_qualified_name").alias("_n")).agg(F.min("id").alias("type_id"))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"[*&\s]+$", ""), "^const ", ""))
    parent = functions.where("parent_id IS NOT NULL").select("id", F.lit(0).alias("_o"), F.lit("parent").alias("section"), F.col("parent_id").alias("type_id"))
    used = functions.select("id", F.explode("parameters").alias("p")).select("id", F.lit(1).alias("_o"), F.lit("parameter").alias("section"), bare(F.col("p.type")).alias("_n"))
    result = functions.select("id", F.lit(2).alias("_o"), F.lit("result").alias("section"), bare(F.col("returns")).alias("_n"))
    direct = parent.unionByName(used.unionByName(result).join(named, "_n").drop("_n"))
    above = direct.join(bases.where("related_type_id IS NOT NULL").select(F.col("parent_type_id").alias("type_id"), F.col("related_type_id").alias("_b")), "type_id").select("id", F.lit(3).alias("_o"), F.lit("base").alias("section"), F.col("_b").alias("type_id"))
    return direct.unionByName(above).groupBy("id", "type_id").agg(F.min_by("section", "_o").alias("section")).select("id", "section", "type_id")
