"""Texts from a catalog: headers, bindings for another language, and the references of a prompt.

Every line is a row (group, place, text); a text is its lines in order.  Nothing is concatenated before the rows of a group meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import strings as S
from orrery.functions.target import mapped
from orrery.plans.shared import written


def joined_lines(rows: DataFrame, key: str, order: list[str], text: str = "text", between: str = "\n", alias: str = "content") -> DataFrame:
    """One text per key: its rows in order."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("_l"))
    return listed.select(key, F.array_join(F.transform("_l", lambda x: x[text]), between).alias(alias))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def member_text(m: DataFrame) -> Column:
    """A member as it stands in a header; columns: type_string, name, array_size, is_array, bit_width, is_function_pointer, parameters, convention, member_offset."""
    kind = S.remap(F.coalesce("type_string", F.lit("")))
    size = F.when(F.col("is_array"), F.concat(F.lit("["), F.coalesce(F.col("array_size").cast("string"), F.lit("")), F.lit("]"))).otherwise("")
    bits = F.when(F.col("bit_width").isNotNull(), F.concat(F.lit(" : "), F.col("bit_width").cast("string"))).otherwise("")
    offset = F.when(F.col("member_offset").isNotNull(), F.concat(F.lit("/* 0x"), F.lpad(F.hex("member_offset"), 3, "0"), F.lit(" */ "))).otherwise("")
    plain = F.concat(kind, F.lit(" "), F.col("name"), size, bits)
    pointer = F.concat(kind, F.lit(" ("), F.coalesce("convention", F.lit("")), F.when(F.length("convention") > 0, " ").otherwise(""), F.lit("*"), F.col("name"), F.lit(")("), F.coalesce("parameters", F.lit("")), F.lit(")"))
    return F.concat(F.lit("    "), offset, F.when(F.col("is_function_pointer"), pointer).otherwise(plain), F.lit(";"))


def enum_texts(enums: DataFrame, values: DataFrame) -> DataFrame:
    """id, content of enums (id, full_name, is_bitmask) with values (enum_id, position, name, value)."""
    head = enums.select("id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat(F.lit("enum "), F.when(F.col("is_bitmask"), "__bitmask ").otherwise(""), F.col("full_name"), F.lit("\n{")).alias("text"))
    own = F.concat(F.lit("    "), F.col("name"), F.when(F.length("value") > 0, F.concat(F.lit(" = "), F.col("value"))).otherwise(""), F.lit(","))
    body = values.select(F.col("enum_id").alias("id"), F.lit(1).alias("a"), F.col("position").alias("b"), own.alias("text"))
    tail = enums.select("id", F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit("};").alias("text"))
    return joined_lines(_union([head, body, tail]), "id", ["a", "b"])


def struct_keyword(source: Column) -> Column:
    """By what the source contains: ``class``, else ``union``, else ``struct``."""
    return F.when(F.contains(F.coalesce(source, F.lit("")), F.lit("class")), "class").when(F.contains(F.coalesce(source, F.lit("")), F.lit("union")), "union").otherwise("struct")


def struct_texts(types: DataFrame, members: DataFrame, bases: DataFrame) -> DataFrame:
    """id, content of types (id, full_name, source, alignment) with members (see :func:`member_text`) and bases."""
    inherits = bases.where(F.length("related_type_string") > 0).groupBy(F.col("parent_type_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("id").alias("_i"), "related_type_string"))).alias("_b"))
    named = types.join(inherits, "id", "left")
    above = F.when(F.size("_b") > 0, F.concat(F.lit(" : "), F.array_join(F.transform("_b", lambda x: x["related_type_string"]), ", "))).otherwise("")
    align = F.when(F.col("alignment").isNotNull(), F.concat(F.lit("__declspec(align("), F.col("alignment").cast("string"), F.lit(")) "))).otherwise("")
    head = named.select("id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(struct_keyword(F.col("source")), F.lit(" "), align, F.col("full_name"), above, F.lit("\n{")).alias("text"))
    body = members.select(F.col("struct_id").alias("id"), F.lit(1).alias("a"), F.col("decl_order").alias("b"), F.col("id").alias("c"), member_text(members).alias("text")).join(types.select("id"), "id", "left_semi")
    tail = types.select("id", F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit("};").alias("text"))
    return joined_lines(_union([head, body, tail]), "id", ["a", "b", "c"])


def headers(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """path, output_file, content: one header per file of a grouping (output_file, path, type_id) and texts of types (id, content)."""
    rows = groups.join(texts.withColumnRenamed("id", "type_id"), "type_id")
    listed = rows.groupBy("path", "output_file").agg(F.array_sort(F.collect_list(F.struct("type_id", "content"))).alias("_l"))
    return listed.select("path", F.concat(F.substring_index("output_file", "::", -1), F.lit(".h")).alias("file"), F.concat(F.lit("#pragma once\n\n"), F.array_join(F.transform("_l", lambda x: x["content"]), "\n\n"), F.lit("\n")).alias("content"))


def write_files(rows: DataFrame, directory: str) -> None:
    """Writes path, file, content as files below a directory all tasks can reach, replacing what was there."""
    import shutil

    shutil.rmtree(directory, ignore_errors=True)

    def write(part) -> None:
        from pathlib import Path

        for r in part:
            at = Path(directory, r["path"] or "")
            at.mkdir(parents=True, exist_ok=True)
            (at / r["file"]).write_text(r["content"])

    rows.select("path", "file", "content").foreachPartition(write)


def enum_widths(values: DataFrame) -> DataFrame:
    """enum_id, width: the smallest type that holds all literals that can be read."""
    n = S.enum_value(F.col("value"))
    low, high = F.least(F.coalesce(F.min(n), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.max(n), F.lit(0)), F.lit(0))
    signed = F.when((low >= -128) & (high <= 127), "sbyte").when((low >= -32768) & (high <= 32767), "short").when((low >= -(2**31)) & (high <= 2**31 - 1), "int").otherwise("long")
    plain = F.when(high >= 2**31 - 1, "uint").when(high <= 255, "byte").when(high <= 65535, "ushort").otherwise("uint")
    return values.groupBy("enum_id").agg(F.when(low < 0, signed).otherwise(plain).alias("width"))


def best_candidates(types: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of types that get the same name in the target (``generated``), the id of the richest: members and functions, bases, length of source."""
    rows = types.join(sizes, "id", "left")
    rank = F.struct(-F.coalesce("n_parts", F.lit(0)), -F.coalesce("n_bases", F.lit(0)), -F.coalesce(F.length("source"), F.lit(0)), "id")
    return rows.groupBy("generated").agg(F.min_by("id", rank).alias("id"))


def binding_texts(types: DataFrame, members: DataFrame, bases: DataFrame, values: DataFrame, space: str = "Bindings") -> DataFrame:
    """id, content: each type as a struct or enum of the target language.

    Bases come first as fields, then members; pointers to functions are thunks without a type; fixed arrays of primitives stay arrays.
    """
    name = S.clean_type_name(F.regexp_replace("base_name", "[<>,*& ]+", "_"))
    enums = types.where("kind = 'Enum'").join(enum_widths(values).withColumnRenamed("enum_id", "id"), "id", "left")
    enum_head = enums.select("id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("public enum "), S.sanitize(name), F.lit(" : "), F.coalesce("width", F.lit("uint")), F.lit("\n{")).alias("text"))
    literal = F.concat(F.lit("    "), S.sanitize(F.col("name")), F.when(F.length("value") > 0, F.concat(F.lit(" = "), F.col("value"))).otherwise(""), F.lit(","))
    enum_body = values.select(F.col("enum_id").alias("id"), F.lit(1).alias("a"), F.col("position").alias("b"), F.lit(0).alias("c"), literal.alias("text"))
    structs = types.where("kind <> 'Enum'")
    head = structs.select("id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.concat(F.lit("public unsafe struct "), S.sanitize(name), F.lit("\n{")).alias("text"))
    first = bases.where(F.length("related_type_string") > 0).select(F.col("parent_type_id").alias("id"), F.lit(1).alias("a"), F.col("ord").alias("b"), F.col("id").alias("c"), F.concat(F.lit("    public "), mapped(F.col("related_type_string"), None, space), F.lit(" BaseClass_"), S.clean_type_name(F.regexp_replace(S.base_type_name(F.col("related_type_string")), r"\W+", "_")), F.lit(";")).alias("text"))
    kind = F.when(F.col("is_function_pointer"), F.lit("System.IntPtr")).otherwise(mapped(F.col("type_string"), None, space))
    many = F.coalesce(F.col("is_array"), F.lit(False)) & ~F.col("is_function_pointer")
    primitive = kind.isin("byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "char")
    size = F.coalesce(F.col("array_size"), F.lit(1)).cast("string")
    field = F.when(many & primitive, F.concat(F.lit("    public fixed "), kind, F.lit(" "), S.sanitize(F.col("name")), F.lit("["), size, F.lit("];"))).otherwise(F.concat(F.lit("    public "), kind, F.lit(" "), S.sanitize(F.col("name")), F.lit(";")))
    body = members.select(F.col("struct_id").alias("id"), F.lit(2).alias("a"), F.col("decl_order").alias("b"), F.col("id").alias("c"), field.alias("text"))
    tail = types.select("id", F.lit(3).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit("}").alias("text"))
    rows = _union([enum_head, enum_body, head, first, body, tail]).join(types.select("id"), "id", "left_semi")
    return joined_lines(rows, "id", ["a", "b", "c"])


def namespaces(types: DataFrame, texts: DataFrame, space: str = "Bindings") -> DataFrame:
    """namespace, content: the texts of types (id, content) of each namespace in one block."""
    where = F.when(F.length("namespace") > 0, F.concat(F.lit(f"{space}."), F.replace("namespace", F.lit("::"), F.lit(".")))).otherwise(space)
    rows = types.select("id", where.alias("namespace")).join(texts, "id")
    listed = rows.groupBy("namespace").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("_l"))
    return listed.select("namespace", F.concat(F.lit("namespace "), F.col("namespace"), F.lit(";\n\n"), F.array_join(F.transform("_l", lambda x: x["content"]), "\n\n"), F.lit("\n")).alias("content"))


def with_helpers(files: DataFrame, helpers: DataFrame) -> DataFrame:
    """Files (path, file, content) whose key a hand-written helper (name, content) takes over, and the helpers that fit none, in ``Manual``."""
    taken = files.withColumn("_k", F.regexp_replace("file", r"\.\w+$", "")).join(helpers.select(F.col("name").alias("_k"), F.col("content").alias("_c")), "_k", "left")
    left = helpers.join(files.select(F.regexp_replace("file", r"\.\w+$", "").alias("name")), "name", "left_anti")
    return taken.select("path", "file", F.coalesce("_c", "content").alias("content")).unionByName(left.select(F.lit("Manual").alias("path"), F.concat(F.replace("name", F.lit("::"), F.lit("__")), F.lit(".cs")).alias("file"), "content"))


def with_comments(texts: DataFrame, comments: DataFrame) -> DataFrame:
    """Texts (id, full_name, content) under their comments (full_name, comment), each line of which gets ``/// ``."""
    shown = F.concat(F.array_join(F.transform(F.split("comment", "\n"), lambda x: F.concat(F.lit("/// "), x)), "\n"), F.lit("\n"))
    return texts.join(comments, "full_name", "left").select("id", "full_name", F.concat(F.coalesce(shown, F.lit("")), F.col("content")).alias("content"))


def term_hits(terms: DataFrame, bodies: DataFrame, text: str, most: int = 20, block: int = 50_000) -> DataFrame:
    """owner_id, body_id, hits: for each owner of terms (owner_id, term) the texts (id, ``text``) that contain most of its terms, as a
    top-``most`` report.  Terms are literal, without regard to case; blank ones don't count.

    The terms are the stated set: they go out in blocks of ``block``, each as one automaton that a text passes once, so no term is paired
    with a text that doesn't contain it.
    """
    import ahocorasick
    import pandas as pd
    from pyspark.sql.window import Window as W

    asked = written(terms.select("owner_id", F.lower("term").alias("term")).where(F.length(F.trim("term")) > 0).distinct())
    words = asked.select("term").distinct()
    spark, parts = terms.sparkSession, []
    n = words.count()
    numbered = words.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(-(-n // block) or 1)))
    for b in range(-(-n // block)):
        automaton = ahocorasick.Automaton()
        for (word,) in numbered.where(F.col("_b") == b).select("term").collect():
            automaton.add_word(word, word)
        if not len(automaton):
            continue
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)

        def find(batches, shared=shared):
            for rows in batches:
                got = [(i, w) for i, t in zip(rows.body_id, rows.text) if t for w in {w for _, w in shared.value.iter(t)}]
                yield pd.DataFrame(got, columns=["body_id", "term"])

        parts.append(bodies.select(F.col("id").alias("body_id"), F.lower(text).alias("text")).mapInPandas(find, "body_id bigint, term string"))
    if not parts:
        return spark.createDataFrame([], "owner_id bigint, body_id bigint, hits bigint")
    found = reduce(DataFrame.unionByName, parts).distinct()
    hits = found.join(asked, "term").groupBy("owner_id", "body_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("owner_id").orderBy(F.desc("hits"), "body_id"))).where(F.col("_n") <= most).drop("_n")
