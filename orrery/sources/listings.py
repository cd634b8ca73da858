"""Source texts as tables: one row per file goes in, rows of definitions, members, values, functions and static variables come out.

Files are read whole, as a definition needs its lines in order; a file is the unit of work, so any number of them is read in
parallel.  Each text is parsed once per kind of row, in Arrow batches; everything after that is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.functions import cpp
from orrery.functions.strings import is_static_line
from orrery.plans.shared import hot_keys, join_to_keys, row_numbers, written

_PARAMETERS = "array<struct<position: int, name: string, type: string, pointer_depth: int, is_function_pointer: boolean, is_const: boolean>>"
_MEMBERS = (
    "array<struct<name: string, type_string: string, decl_order: int, overload_index: int, member_offset: int, alignment: int, bit_width: int, is_array: boolean, "
    f"array_size: int, pointer_depth: int, is_function_pointer: boolean, convention: string, signature: string, parameters: {_PARAMETERS}, line: int>>"
)
DEFINITIONS = (
    "array<struct<kind: string, name: string, namespace: string, full_name: string, line: int, source: string, alignment: int, is_volatile: boolean, is_bitmask: boolean, "
    f"refers_to: string, signature: string, arguments: array<string>, bases: array<string>, members: {_MEMBERS}, values: array<struct<name: string, value: string, line: int>>>>"
)
FUNCTIONS = f"array<struct<name: string, owner: string, offset: bigint, line: int, returns: string, convention: string, signature: string, parameters: {_PARAMETERS}, body: string>>"
TYPE_NODES = "array<struct<path: string, text: string, base: string, pointer_depth: int>>"
REFERENCE = "struct<type_string: string, fully_qualified_type: string, is_const: boolean, is_pointer: boolean, is_reference: boolean, pointer_depth: int>"
STATIC = "struct<address: string, name: string, type_string: string, global_type: string>"
#: The order in which kinds of a file are taken.
KIND_ORDER = ("Struct", "Enum", "Union", "Typedef")


def _parameters(signature: cpp.Signature | None) -> list[dict]:
    return [{"position": p.position, "name": p.name, "type": p.type, "pointer_depth": p.pointers, "is_function_pointer": p.signature is not None, "is_const": p.const} for p in (signature.parameters if signature else [])]


def _member(m: cpp.Member) -> dict:
    return {
        "name": m.name, "type_string": m.type_string, "decl_order": m.order, "overload_index": m.overload, "member_offset": m.offset, "alignment": m.alignment, "bit_width": m.bits,
        "is_array": m.array, "array_size": m.array_size, "pointer_depth": m.pointers, "is_function_pointer": m.signature is not None,
        "convention": m.signature.convention if m.signature else None, "signature": m.signature.normalized if m.signature else None, "parameters": _parameters(m.signature), "line": m.line,
    }


def _definition(d: cpp.Definition) -> dict:
    return {
        "kind": d.kind, "name": d.name, "namespace": d.namespace, "full_name": d.full_name, "line": d.line, "source": d.source, "alignment": d.alignment, "is_volatile": d.volatile,
        "is_bitmask": d.bitmask, "refers_to": d.refers_to or None, "signature": d.signature.normalized if d.signature else None, "arguments": d.arguments, "bases": d.bases,
        "members": [_member(m) for m in d.members], "values": [dict(zip(("name", "value", "line"), v)) for v in d.values],
    }


def _function(f: cpp.Function) -> dict:
    s = f.signature
    return {"name": s.name, "owner": f.owner or None, "offset": f.offset, "line": f.line, "returns": s.returns, "convention": s.convention, "signature": s.normalized, "parameters": _parameters(s), "body": f.body}


def _listed(schema: str, read):
    """A UDF from a text to an array of structs; null gives an empty one."""

    @F.pandas_udf(schema)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([read(t) if t else [] for t in batch], dtype=object)

    return parse


def definitions_of(text: Column) -> Column:
    return _listed(DEFINITIONS, lambda t: [_definition(d) for d in cpp.parse_definitions(t)])(text)


def functions_of(text: Column) -> Column:
    return _listed(FUNCTIONS, lambda t: [_function(f) for f in cpp.parse_functions(t)])(text)


def type_nodes_of(text: Column) -> Column:
    """The tree of a type and its template arguments, as rows."""
    return _listed(TYPE_NODES, lambda t: [dict(zip(("path", "text", "base", "pointer_depth"), n)) for n in cpp.parse_type(cpp.normalize(t)).nodes()])(text)


def statics_of(line: Column) -> Column:
    names = ("address", "name", "type_string", "global_type")
    return _listed(f"array<{STATIC}>", lambda t: [dict(zip(names, s)) for s in [cpp.parse_static(t)] if s])(line)


def references_of(text: Column) -> Column:
    return F.get(_listed(f"array<{REFERENCE}>", lambda t: [cpp.reference(t)])(text), 0)


def parameters_of(text: Column) -> Column:
    return _listed(_PARAMETERS, lambda t: _parameters(cpp.Signature("", "", "", cpp.parse_parameters(t))))(text)


def signature_of(text: Column) -> Column:
    """name, returns, convention, parameters of a whole signature."""

    def read(t: str) -> list[dict]:
        s = cpp.parse_signature(t)
        return [{"name": s.name, "returns": s.returns, "convention": s.convention, "signature": s.normalized, "parameters": _parameters(s)}] if s else []

    return F.get(_listed(f"array<struct<name: string, returns: string, convention: string, signature: string, parameters: {_PARAMETERS}>>", read)(text), 0)


def pointer_of(type_string: Column) -> Column:
    """returns, convention, parameters (as written) of the type of a pointer to a function, which has no name; null for other types."""

    def read(t: str) -> list[dict]:
        s = cpp.parse_function_pointer(re.sub(r"\*\s*\)", "*__name)", t, count=1))
        if not s:
            return []
        whole = t.strip()
        plain = s.name == "__name" and re.search(r"\*\s*\)$", whole[: cpp.opening(whole, len(whole) - 1)].rstrip())
        written = whole[cpp.opening(whole, len(whole) - 1) + 1 : -1].strip() if plain else ", ".join(p.type for p in s.parameters)
        return [{"returns": s.returns, "convention": s.convention, "parameters": written}]

    return F.get(_listed("array<struct<returns: string, convention: string, parameters: string>>", read)(type_string), 0)


def member_names_of(source: Column) -> Column:
    return _listed("array<string>", cpp.member_names)(source)


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """file, text: whole files, lines kept as they are."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text."""
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "text")).select("file", (F.col("n") + 1).alias("line"), "text")


def definitions(files: DataFrame) -> DataFrame:
    """file and the columns of a definition, for every definition of every file (file, text)."""
    return files.select("file", F.explode(definitions_of(F.col("text"))).alias("d")).select("file", "d.*")


def first_definitions(found: DataFrame) -> DataFrame:
    """Of the definitions of a name the first one, by file, kind and line; a struct without members gives way to one that has some.

    All kinds share their names; a name that the first definition gave to one kind isn't taken by another.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")).cast("int")
    by_name = W.partitionBy("full_name")
    order = [F.col("file"), F.col("_rank"), F.col("line")]
    return (
        found.withColumn("_rank", rank)
        .withColumn("_kind", F.first("kind").over(by_name.orderBy(*order)))
        .withColumn("_n", F.row_number().over(by_name.orderBy(F.col("kind") != F.col("_kind"), (F.col("kind") == "Struct") & (F.size("members") == 0), *order)))
        .where("_n = 1")
        .drop("_rank", "_kind", "_n")
    )


def catalog_tables(files: DataFrame) -> dict[str, DataFrame]:
    """The tables of a catalog from source files (file, text).  Ids follow file, kind and line, however the work is spread.

    References have no referenced_type_id yet; that is the work of ``operators.resolution.resolve_references``.
    """
    from orrery.operators.resolution import static_owners

    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind")).cast("int").alias("_rank")
    kept = written(row_numbers(first_definitions(definitions(files)).select("*", rank), ["file", "_rank", "line", "full_name"], "id"))
    code = F.when(F.col("kind") == "Enum", 1).when(F.col("kind") == "Struct", 2).when(F.col("kind") == "Union", 4).when(F.col("kind") == "Typedef", 5).otherwise(0)
    types = kept.where("kind <> 'Typedef'").select(
        "id", F.col("name").alias("base_name"), "namespace", "kind", code.alias("kind_code"), "source", F.col("full_name").alias("stored_fully_qualified_name"),
        (F.endswith("name", F.lit("_vtbl")) & (F.col("kind") == "Struct")).alias("is_vtable"), "is_volatile", "is_bitmask", F.col("file").alias("source_file"), F.col("line").alias("line_number"), "alignment",
    )
    members = row_numbers(kept.select("id", F.explode("members").alias("m")).select(F.col("id").alias("struct_id"), "m.*"), ["struct_id", "decl_order"], "id")
    bases = row_numbers(kept.select("id", F.posexplode("bases").alias("ord", "related_type_string")).withColumnRenamed("id", "parent_type_id"), ["parent_type_id", "ord"], "id")
    bases = bases.withColumn("related_type_id", F.lit(None).cast("int"))
    arguments = row_numbers(kept.select("id", F.posexplode("arguments").alias("position", "type_string")).withColumnRenamed("id", "parent_type_id"), ["parent_type_id", "position"], "id")
    values = row_numbers(kept.select("id", F.posexplode("values").alias("position", "v")).select(F.col("id").alias("enum_id"), "position", "v.*"), ["enum_id", "position"], "id")
    typedefs = kept.where("kind = 'Typedef'").select("id", "name", "namespace", F.col("refers_to").alias("type_string"), "signature")
    functions = files.select("file", F.explode(functions_of(F.col("text"))).alias("f")).select("file", "f.*")
    functions = row_numbers(functions, ["file", "line"], "id")
    statics = lines(files).where(is_static_line(F.col("text"))).select("file", "line", F.explode(statics_of(F.col("text"))).alias("s")).select("file", "line", "s.*")
    statics = written(static_owners(row_numbers(statics, ["file", "line"], "id"), types))
    members, functions, typedefs = written(members), written(functions), written(typedefs)
    # Signatures of bodies, of pointers among members and of typedefs, and the parameters they have.
    signed = functions.select(F.lit("Body").alias("origin"), F.col("id").alias("origin_id"), "name", "signature", "convention", "returns", "parameters").unionByName(
        members.where("is_function_pointer").select(F.lit("Member").alias("origin"), F.col("id").alias("origin_id"), "name", "signature", "convention", F.col("type_string").alias("returns"), "parameters")
    )
    signatures = written(row_numbers(signed, ["origin", "origin_id"], "id"))
    parameters = signatures.select(F.col("id").alias("signature_id"), F.explode("parameters").alias("p")).select("signature_id", "p.*").withColumnRenamed("type", "type_string")
    parameters = written(row_numbers(parameters, ["signature_id", "position"], "id"))
    # Every written use of a type is a reference; equal ones are one.
    plain = lambda df, c: df.select(F.col(c).alias("type_string"), F.lit(False).alias("is_array"), F.lit(None).cast("int").alias("array_size"))
    used = members.where("NOT is_function_pointer").select("type_string", "is_array", "array_size")
    for df, c in ((bases, "related_type_string"), (arguments, "type_string"), (parameters, "type_string"), (signatures, "returns"), (typedefs, "type_string"), (statics, "type_string")):
        used = used.unionByName(plain(df, c))
    used = row_numbers(used.where("length(trim(type_string)) > 0").distinct(), ["type_string", "is_array", "array_size"], "id").withColumn("r", references_of(F.col("type_string")))
    references = written(used.select("id", "type_string", "r.fully_qualified_type", F.lit(None).cast("int").alias("referenced_type_id"), "r.is_const", "r.is_pointer", "r.is_reference", "r.pointer_depth", "is_array", "array_size"))
    key = lambda t, a, n: F.concat_ws("\u0001", t, a.cast("string"), F.coalesce(n.cast("string"), F.lit("")))
    known = references.select(key(F.col("type_string"), F.col("is_array"), F.col("array_size")).alias("_key"), F.col("id").alias("type_reference_id"))

    def referring(df: DataFrame, c: str, out: str = "type_reference_id", array: Column | None = None, n: Column | None = None) -> DataFrame:
        keyed = df.withColumn("_key", key(F.col(c), F.lit(False) if array is None else array, F.lit(None).cast("int") if n is None else n))
        hot = hot_keys(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", "n", least=1 << 16)
        return join_to_keys(keyed, known.withColumnRenamed("type_reference_id", out), "_key", "id", hot, "left", merge=False).drop("_key")

    return {
        "types": types, "type_inheritances": referring(bases, "related_type_string"), "type_arguments": referring(arguments, "type_string"), "enum_members": values, "function_bodies": functions,
        "struct_members": referring(members, "type_string", array=F.col("is_array"), n=F.col("array_size")), "typedefs": referring(typedefs, "type_string"), "static_variables": referring(statics, "type_string"),
        "type_references": references, "function_signatures": referring(signatures.drop("parameters"), "returns", "return_reference_id"), "function_parameters": referring(parameters, "type_string"),
    }
