"""Reads and changes of a catalog: every question that can be put to its tables, as a plan over DataFrames.

Children are gathered into arrays before they are joined to their parents, so no join multiplies rows; every "first" has an
order.  A change makes a new table; ``save`` replaces the old one only when the new one is complete.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window as W

from orrery.functions import strings as S
from orrery.sources.tables import replace, table


def gathered(children: DataFrame, key: str, order: list[str], *columns: str, alias: str = "items") -> DataFrame:
    """One row per key with its children as an ordered array of structs."""
    rest = [c for c in columns if c not in order]
    return children.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(alias))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in ``order``, found while aggregating."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*keys, "_f.*")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: the place of each row among those of its keys, from 0.

    Rows of a key pass sorted, and spilled where they don't fit; only the count is kept.
    """
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def told_apart(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with names that occur several times among their keys numbered from 1."""
    several = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = numbered(df, [*keys, name], order, "_k").join(several, [*keys, name], "left")
    return rows.withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("_", name, (F.col("_k") + 1).cast("string"))).otherwise(F.col(name))).drop("_n", "_k")


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """``name``, n of names that occur several times."""
    return df.where(F.length(name) > 0).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def new_rows(existing: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The rows of ``new`` whose name ``existing`` doesn't have."""
    return new.join(existing.select(name).distinct(), name, "left_anti")


def last(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows: a report."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def tagged(**parts: DataFrame) -> DataFrame:
    """origin, id of the rows of several tables, each under its keyword."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(tag).alias("origin"), "id") for tag, df in parts.items()])


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of those that share an ``id``; rows without one are kept unless wholly identical.  Columns nobody asks for aren't read."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()).distinct())


class Catalog:
    """The tables of a directory.  Tables that a catalog doesn't have are missing only when asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    @property
    def types(self) -> DataFrame:
        return self.table("types")

    @property
    def references(self) -> DataFrame:
        return self.table("type_references")

    @property
    def members(self) -> DataFrame:
        return once(self.table("struct_members"))

    @property
    def bases(self) -> DataFrame:
        return once(self.table("type_inheritances"))

    @property
    def bodies(self) -> DataFrame:
        return once(self.table("function_bodies"))

    # Filters.

    def by_id(self, name: str, ident: int) -> DataFrame:
        return self.table(name).where(F.col("id") == ident).orderBy("id").limit(1)

    def types_in(self, namespace: str) -> DataFrame:
        return self.types.where(F.col("namespace") == namespace)

    def types_of_kind(self, kind: str) -> DataFrame:
        return self.types.where(F.col("kind") == kind)

    def type_named(self, name: str) -> DataFrame:
        return self.types.where(F.col("stored_fully_qualified_name") == name).orderBy("id").limit(1)

    def all_types(self, with_ignored: bool = False) -> DataFrame:
        return self.types if with_ignored else self.types.where(~F.col("is_ignored"))

    def search(self, term: str, with_ignored: bool = False) -> DataFrame:
        """Types whose base name, namespace or full name contains a text, without regard to case."""
        hit = reduce(or_, [F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in ("base_name", "namespace", "stored_fully_qualified_name")])
        return self.all_types(with_ignored).where(hit)

    def group(self, base_name: str, namespace: str) -> DataFrame:
        """A type and all that is filed under it."""
        full = f"{namespace}::{base_name}" if namespace else base_name
        return self.types.where(((F.col("base_name") == base_name) & (F.coalesce("namespace", F.lit("")) == namespace)) | (F.col("base_type_path") == full))

    def children(self, name: str, key: str, ids: DataFrame | None = None) -> DataFrame:
        """Rows of a child table, of some parents (``ids``: one column ``id``) or of all."""
        rows = once(self.table(name))
        return rows if ids is None else rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi")

    def unresolved(self) -> DataFrame:
        """origin, id, text of what names a type without having its id, and is no primitive type."""
        return self.unresolved_with_primitives().where(~S.is_primitive(F.col("text")))

    def unresolved_with_primitives(self) -> DataFrame:
        parts = [("TypeReference", self.references, "referenced_type_id", "type_string"), ("Inheritance", self.bases, "related_type_id", "related_type_string")]
        return reduce(DataFrame.unionByName, [t.where(F.col(i).isNull() & (F.length(s) > 0)).select(F.lit(o).alias("origin"), "id", F.col(s).alias("text")) for o, t, i, s in parts])

    def unresolved_count(self) -> DataFrame:
        return self.unresolved().agg(F.count(F.lit(1)).alias("n"))

    def unresolved_sample(self, n: int = 5) -> DataFrame:
        """The first ``n``, references before inheritances."""
        rank = F.when(F.col("origin") == "TypeReference", 0).otherwise(1)
        return self.unresolved().orderBy(rank, "id").limit(n).select(F.concat_ws(": ", "origin", "text").alias("sample"))

    def work_items(self, kinds: tuple[str, ...], only: str | None = None) -> DataFrame:
        rows = self.all_types().where(F.col("kind").isin(*kinds))
        rows = rows if only is None else rows.where(F.col("stored_fully_qualified_name") == only)
        return rows.select("id", F.col("kind").alias("entity_type"), F.coalesce("stored_fully_qualified_name", "base_name", F.lit("Unknown")).alias("full_name"))

    def named_without(self, prefix: str) -> DataFrame:
        return self.types.where(~F.col("base_name").startswith(prefix))

    def first_bases(self) -> DataFrame:
        """parent_type_id, base_id: the first base of each type."""
        return self.bases.where("related_type_id IS NOT NULL").groupBy("parent_type_id").agg(F.min_by("related_type_id", F.struct("ord", "id")).alias("base_id"))

    def first_slots(self) -> DataFrame:
        """struct_id, name, slot: the offset of the first member of each name, without regard to case."""
        placed = self.members.where("member_offset IS NOT NULL AND struct_id IS NOT NULL")
        return placed.groupBy("struct_id", F.lower("name").alias("name")).agg(F.min_by("member_offset", F.struct("decl_order", "id")).alias("slot"))

    def first_bodies(self) -> DataFrame:
        """fully_qualified_name, id: the first body of each signature."""
        return self.bodies.where("fully_qualified_name IS NOT NULL").groupBy("fully_qualified_name").agg(F.min("id").alias("id"))

    def used_ids(self) -> DataFrame:
        """id of all types that something refers to."""
        return self.references.where("referenced_type_id IS NOT NULL").select(F.col("referenced_type_id").alias("id")).union(self.bases.where("related_type_id IS NOT NULL").select("related_type_id")).distinct()

    def method_items(self) -> DataFrame:
        """Functions whose owner is a type that isn't ignored."""
        return self.bodies.join(self.all_types().select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("id", F.lit("StructMethod").alias("entity_type"), F.coalesce("fully_qualified_name", F.lit("Unknown")).alias("full_name"))

    # Projections and joins.

    def lookup(self) -> DataFrame:
        return self.all_types().select("id", "base_name", "namespace", "stored_fully_qualified_name")

    def lookup_by_name(self) -> DataFrame:
        """The last id of each full name."""
        return self.lookup().where("stored_fully_qualified_name IS NOT NULL").groupBy("stored_fully_qualified_name").agg(F.max("id").alias("id"))

    def lookup_by_base_name(self) -> DataFrame:
        """The ids of each base name, without regard to case."""
        return self.lookup().groupBy(F.lower("base_name").alias("base_name")).agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def types_with_bases(self) -> DataFrame:
        bases = gathered(self.bases, "parent_type_id", ["ord", "id"], "related_type_id", "related_type_string", alias="bases").withColumnRenamed("parent_type_id", "id")
        return self.types.join(bases, "id", "left").withColumn("bases", F.coalesce("bases", F.array().cast(dict(bases.dtypes)["bases"])))

    def members_with_references(self) -> DataFrame:
        refs = self.references.select(F.col("id").alias("type_reference_id"), "referenced_type_id", "is_pointer", "pointer_depth", F.col("is_array").alias("ref_is_array"), "array_size", F.col("type_string").alias("ref_string"))
        return self.members.join(refs, "type_reference_id", "left")

    def members_with_types(self) -> DataFrame:
        types = self.types.select(F.col("id").alias("referenced_type_id"), F.col("base_name").alias("type_base_name"), F.col("kind").alias("type_kind")).dropDuplicates(["referenced_type_id"])
        return self.members_with_references().join(types, "referenced_type_id", "left")

    def bases_with_types(self) -> DataFrame:
        types = self.types.select(F.col("id").alias("related_type_id"), F.col("base_name").alias("related_base_name")).dropDuplicates(["related_type_id"])
        return self.bases.join(types, "related_type_id", "left")

    def bodies_with_owners(self) -> DataFrame:
        types = self.types.select(F.col("id").alias("parent_id"), F.col("base_name").alias("owner_base_name")).dropDuplicates(["parent_id"])
        return self.bodies.join(types, "parent_id", "left")

    def whole_types(self) -> DataFrame:
        """Types with bases, members and functions as arrays."""
        members = gathered(self.members, "struct_id", ["decl_order", "id"], "name", "type_string", alias="members").withColumnRenamed("struct_id", "id")
        bodies = gathered(self.bodies, "parent_id", ["id"], "fully_qualified_name", alias="bodies").withColumnRenamed("parent_id", "id")
        return self.types_with_bases().join(members, "id", "left").join(bodies, "id", "left")


# Changes.


class DuplicateNames(ValueError):
    """Rows to insert have no name, or a name that occurs twice among them."""


def insert(existing: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``existing`` and the rows of ``new`` whose name it doesn't have.  Names must be there and differ among the new rows."""
    wrong = new.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col(name).isNull() | (F.col(name) == "") | (F.col("n") > 1)).orderBy(name).limit(10).collect()
    if wrong:
        raise DuplicateNames(f"{len(wrong)} or more names are empty or occur several times: {[r[0] for r in wrong]}")
    return existing.unionByName(new_rows(existing, new, name), allowMissingColumns=True)


def update(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the columns of ``changes`` (one row per key) where those aren't null."""
    names = [c for c in changes.columns if c != key]
    joined = existing.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in existing.columns])


def delete(existing: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` without the rows whose key is among ``ids`` (one column, ``id``)."""
    return existing.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti").select(*existing.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: Column, kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the last by ``order``.  Columns in ``kept`` stay as the first row had them."""
    rows = existing.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")), allowMissingColumns=True)
    rest = [c for c in existing.columns if c not in keys]
    when = F.struct(F.col("_new"), order.alias("o"))
    agg = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), when).alias("_last"), F.min_by(F.struct(*rest), when).alias("_first"))
    return agg.select(*[F.col(c) if c in keys else F.col(f"_first.{c}" if c in kept else f"_last.{c}").alias(c) for c in existing.columns])


def save(df: DataFrame, directory: str, name: str) -> None:
    """Replaces a table when its new version is written completely; readers see the old or the new one."""
    replace(df, directory, name)
