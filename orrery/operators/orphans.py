"""References to records that do not exist.

References and parents are brought together by their key: both sides are partitioned and sorted by it and merged in one
linear pass (Spark's sort-merge join, asked for by hint).  A parent key stands for an interval of validity: it begins with
the earliest row of that key, ends with a removal, or never began.  The interval decides the state of a reference:

* ``late`` - the parent exists, but its interval begins after the reference was loaded;
* ``deleted`` - no such parent exists, and a removal of it is on record;
* ``missing`` - neither.

Keys that hold a large share of all references are spread over many tasks, and the parent's row goes to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.typekeys import base_key, is_value, type_name, written_key
from orrery.plans.shared import hot_keys, join_to_keys
from orrery.sources.tables import table


def orphans(references: DataFrame, parents: DataFrame, removals: DataFrame, keep: tuple[str, ...] = ("table_name",), ways: int = 64) -> DataFrame:
    """row_id, at, state and the columns ``keep`` of the rows of ``references`` whose parent is missing, deleted or late.

    ``references`` has ``_key`` (a string), ``row_id`` and ``at`` (when it was loaded); ``parents`` has ``_key`` and ``since``; ``removals`` has
    ``_key``.  Other columns don't matter, whatever their names.  A null ``_key`` refers to nothing and gives no row.  A null ``at`` or
    ``since`` is never late; a parent exists from its earliest ``since``, ties make no difference.  Repeated references are all judged,
    repeated parents and removals count once.  Empty tables are tables without parents, removals or references.
    """
    facts = parents.select("_key", F.col("since").alias("_since"), F.lit(1).alias("_here"), F.lit(0).alias("_gone")).unionByName(
        removals.select("_key", F.lit(None).cast("timestamp_ntz").alias("_since"), F.lit(0).alias("_here"), F.lit(1).alias("_gone"))
    )
    intervals = facts.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_since").alias("_since"), F.max("_here").alias("_here"), F.max("_gone").alias("_gone"))
    asked = references.select("_key", "row_id", "at", *keep).where(F.col("_key").isNotNull())
    hot = hot_keys(asked.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")), "_key", "_n")
    state = F.when(F.col("_here") == 1, F.when(F.col("_since") > F.col("at"), "late")).when(F.col("_gone") == 1, "deleted").otherwise("missing")
    return join_to_keys(asked, intervals, "_key", "row_id", hot, "left", ways).select("row_id", "at", *keep, state.alias("state")).where(F.col("state").isNotNull())


def written_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference by id or written type: table_name, row_id, at, _key.

    A set id alone decides; else the string, stripped to what it refers to.  Strings with parentheses are function pointers.
    Rows sharing an id are one record.
    """

    def of(name: str, ident: str, text: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col("id").alias("row_id"), F.col("loaded_at").alias("at"), F.col(ident).alias("_id"), F.col(text).alias("_text"))
        by_name = F.when(~F.contains(F.col("_text"), F.lit("(")), base_key(F.col("_text")))
        key = F.when(F.col("_id").isNotNull(), F.concat(F.lit("#"), F.col("_id").cast("string"))).otherwise(F.concat(F.lit("$"), by_name))
        return rows.select("table_name", "row_id", "at", key.alias("_key"))

    uses, bases = of("type_references", "referenced_type_id", "type_string"), of("type_inheritances", "related_type_id", "related_type_string")
    return uses.unionByName(bases.distinct())


def type_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type row under its id and under its name: _key, since."""
    types = table(spark, sf_dir, "types").select("id", "loaded_at", written_key(type_name()).alias("name"))
    keys = F.array(F.concat(F.lit("#"), F.col("id").cast("string")), F.concat(F.lit("$"), F.col("name")))
    return types.select(F.explode(keys).alias("_key"), F.col("loaded_at").alias("since"))


def type_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "type_removals")
    keys = F.array(F.concat(F.lit("#"), F.col("type_id").cast("string")), F.concat(F.lit("$"), written_key(F.col("fully_qualified_name"))))
    return gone.select(F.explode(keys).alias("_key"))


def type_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, load_month, state of every reference to a type that is missing, deleted or late."""
    primitive = [r[0] for r in table(spark, sf_dir, "primitive_types").where(is_value(F.col("name"))).select(F.concat(F.lit("$"), written_key(F.col("name")))).distinct().collect()]  # a small fixed table
    asked = written_references(spark, sf_dir)
    asked = asked.where(~F.col("_key").isin(*primitive)) if primitive else asked
    found = orphans(asked, type_parents(spark, sf_dir), type_removals(spark, sf_dir))
    return found.select("table_name", "row_id", F.date_format("at", "yyyy-MM").alias("load_month"), "state")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    return found.groupBy("table_name", "load_month", "state").agg(F.count(F.lit(1)).alias("n"))
