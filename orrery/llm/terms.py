"""Frequency of every distinct term, over all occurrences and over records.

1. *Blocks*: each task counts the terms of its own records (Arrow kernels), so a term in most records is one row per block.
2. *Dictionary*: the blocks' terms are range-partitioned and sorted; a term's identifier is its rank, from its rank in its
   partition and the number of terms before that partition (one number per partition goes through the driver).
3. *Count arrays*: encoded, each block adds its counts into dense arrays, one per range of ``WIDTH`` identifiers.
4. *Sums*: the arrays of an identifier range are summed, cell by cell, and decoded.  Encoded counts lie in order of terms, so only tasks
   that read neighbouring parts of them have arrays of the same range.

The number of records is counted along, as that of a term no text can hold (the empty one).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from orrery.plans.shared import written
from orrery.sources.tables import table

#: Identifiers per count array.
WIDTH = 4096
#: Distinct terms a block holds before it hands on its counts and begins anew.
BLOCK_TERMS = 1 << 20


def terms_of(text: Column) -> Column:
    """The longest runs of letters, digits and underscores of a text, in lower case; empty for null."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0)), F.lower), F.array().cast("array<string>"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, terms, once) to (part, term, occurrences, records), as few rows as there are terms in the block."""

    def counted(column: pa.ListArray, part: pa.Array) -> pa.Table:
        flat = pa.table({"part": pc.take(part, pc.list_parent_indices(column)), "term": pc.list_flatten(column)})
        return flat.group_by(["part", "term"]).aggregate([([], "count_all")]).rename_columns(["part", "term", "n"])

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(["part", "term"]).aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns(["part", "term", "occurrences", "records"])

    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        zero = lambda n: pa.array(np.zeros(n, dtype=np.int64))
        occ, rec = counted(batch["terms"], batch["part"]), counted(batch["once"], batch["part"])
        held.append(pa.table({"part": occ["part"], "term": occ["term"], "occurrences": occ["n"], "records": zero(occ.num_rows)}))
        held.append(pa.table({"part": rec["part"], "term": rec["term"], "occurrences": zero(rec.num_rows), "records": rec["n"]}))
        rows += occ.num_rows + rec.num_rows
        if rows > BLOCK_TERMS:
            held = [merged(held)]
            rows = held[0].num_rows
            if rows > BLOCK_TERMS // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged(held).to_batches()


def _count_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, term_id, occurrences, records) to (part, block, occurrences[], records[])."""
    arrays: dict[tuple[int, int], np.ndarray] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"part": [k[0] for k in arrays], "block": [k[1] for k in arrays], "occurrences": [a[0] for a in arrays.values()], "records": [a[1] for a in arrays.values()]})

    for batch in batches:
        block = batch.term_id.to_numpy() // WIDTH
        for (part, b), rows in batch.groupby([batch.part, block]):
            array = arrays.setdefault((part, b), np.zeros((2, WIDTH), dtype=np.int64))
            at = rows.term_id.to_numpy() % WIDTH
            np.add.at(array[0], at, rows.occurrences.to_numpy())
            np.add.at(array[1], at, rows.records.to_numpy())
        if len(arrays) > 512:
            yield out()
            arrays.clear()
    if arrays:
        yield out()


def _summed(arrays: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one (part, block) to (part, term_id, occurrences, records) of the cells that aren't 0."""
    sums = [np.zeros(WIDTH, dtype=np.int64), np.zeros(WIDTH, dtype=np.int64)]
    for total, column in zip(sums, (arrays.occurrences, arrays.records)):
        for array in column:
            total += array
    at = np.flatnonzero(sums[0] | sums[1])
    return pd.DataFrame({"part": np.full(len(at), arrays.part.iloc[0]), "term_id": arrays.block.iloc[0] * WIDTH + at, "occurrences": sums[0][at], "records": sums[1][at]})


def term_counts(records: DataFrame) -> DataFrame:
    """part, term, occurrences, records of ``records`` (part int, text string: one row per record).

    Null and blank texts have no terms; the empty term stands for the records of each part, whether or not they have a text.
    """
    listed = terms_of(F.col("text"))
    tokens = records.select("part", F.concat(F.array(F.lit("")), listed).alias("terms"))
    blocks = written(tokens.select("part", "terms", F.array_distinct("terms").alias("once")).mapInArrow(_block_counts, "part int, term string, occurrences bigint, records bigint"))
    laid = written(blocks.repartitionByRange("term").withColumn("pid", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in laid.groupBy("pid").agg(F.countDistinct("term")).collect())
    before, first = [], 0
    for pid, n in sizes:
        before.append((pid, first))
        first += n
    offsets = F.broadcast(records.sparkSession.createDataFrame(before, "pid int, _before bigint"))  # one row per partition
    laid = laid.join(offsets, "pid")
    encoded = laid.withColumn("term_id", (F.dense_rank().over(W.partitionBy("pid").orderBy("term")) - 1 + F.col("_before")).cast("long"))
    encoded = written(encoded.select("part", "term", "term_id", "occurrences", "records"))
    dictionary = encoded.select("term_id", "term").distinct()
    arrays = encoded.select("part", "term_id", "occurrences", "records").mapInPandas(_count_arrays, "part int, block bigint, occurrences array<bigint>, records array<bigint>")
    sums = arrays.groupBy("part", "block").applyInPandas(_summed, "part int, term_id bigint, occurrences bigint, records bigint")
    return sums.join(dictionary, "term_id").select("part", "term", "occurrences", "records")


def marked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, term, occurrences, records, mark of every term of the fields in term_limits.

    mark is ``rare``, ``common`` or null; rows sharing an id are one record (of the greatest text), rows without one one each.
    """
    fields = [tuple(r) for r in table(spark, sf_dir, "term_limits").select("table_name", "field_name", "min_records", "max_record_share").distinct().orderBy("table_name", "field_name").collect()]
    if not fields:
        return spark.createDataFrame([], "table_name string, term string, occurrences bigint, records bigint, mark string")
    parts = []
    for k, (name, field, _, _) in enumerate(fields):
        rows = table(spark, sf_dir, name).select(F.col("id").alias("id"), F.col(field).alias("text"))
        one = rows.where("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text")).select("text").unionByName(rows.where("id IS NULL").select("text"))
        parts.append(one.select(F.lit(k).alias("part"), "text"))
    counts = written(term_counts(reduce(DataFrame.unionByName, parts)))
    totals = {r[0]: r[1] for r in counts.where("term = ''").select("part", "records").collect()}
    name = mark = F.lit(None).cast("string")
    for k, (t, _, least, share) in enumerate(fields):
        here = F.col("part") == k
        name = F.when(here, t).otherwise(name)
        marks = F.when(F.col("records") < F.lit(least), "rare").when(F.col("records") > F.lit(share) * totals.get(k, 0), "common")
        mark = F.when(here, marks).otherwise(mark)
    return counts.where("term <> ''").select(name.alias("table_name"), "term", "occurrences", "records", mark.alias("mark"))


def terms_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found."""
    return marked_terms(spark, sf_dir).where("mark IS NOT NULL").select("table_name", "term", "mark")
