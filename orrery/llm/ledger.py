"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger has one row per canonical key with its number of copies, its earliest record and that record's value.  It is kept in *runs*:
Parquet tables in the shared folder, bucketed and sorted by key, with as many buckets as their size asks for.  A batch is aggregated
first (so a key of a third of all rows is one row per task by the time it is shuffled), then full-outer-joined, bucket by bucket, with
the runs that aren't much larger than itself; counts are added and the earlier representative is kept.  The larger side of such a join is
read by bucket and never shuffled.  So runs shrink geometrically from the oldest to the newest, there are few of them, and a row is
written again once for each doubling of what it is in, however many batches there are.

A manifest names the runs and batches that count.  A batch is in when the next manifest is there: a job that dies halfway leaves the
ledger as it was, a batch given again under its name changes nothing, and of two writers the second one fails.  A manifest that can't be
read is still being written, or its writer died at the last step; then it has to be deleted before the ledger takes batches again.  Runs
that no manifest names any longer are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.functions.typekeys import written_key
from orrery.plans.shared import forget_at_exit, hot_keys, join_to_keys, shared_dir, written
from orrery.sources.tables import table

SCHEMA = "key string, copies bigint, first_id bigint, first_value string"
#: Keys of a bucket, about.
BUCKET_KEYS = 1 << 20


class Ledger:
    """``Ledger(spark, path)`` opens or begins the ledger at ``path`` (a folder of its own, in the shared one by default, where it is deleted
    at the end).

    Null values, and values whose key is null, are no records and are left out.  A record without an id counts, but represents
    only together with nothing (first_id null).  Of records with equal ids the smaller value represents; an empty batch changes
    nothing; other columns of a batch are ignored, whatever their names.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least_buckets: int | None = None):
        self.spark = spark
        self.least_buckets = least_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        if path is None:
            forget_at_exit(spark, self.path)
        self.version, self.runs, self.batches = 0, [], []  # runs: [folder, buckets, keys], the largest first
        for version in sorted((int(n) for n in self._names("manifest=")), reverse=True):
            try:
                found = json.loads(self._text(f"manifest={version}"))
            except ValueError:  # its writer died
                continue
            self.version, self.runs, self.batches = version, found["runs"], found["batches"]
            break

    def _fs(self, name: str = ""):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        at, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]

    def _text(self, name: str) -> str:
        at, fs = self._fs(name)
        with_lines = self.spark.sparkContext._jvm.java.util.Scanner(fs.open(at), "UTF-8").useDelimiter("\\A")
        text = with_lines.next() if with_lines.hasNext() else ""
        with_lines.close()
        return text

    def _commit(self, runs: list, batches: list) -> None:
        at, fs = self._fs(f"manifest={self.version + 1}")
        out = fs.create(at, False)  # fails if another writer was first
        out.write(json.dumps({"runs": runs, "batches": batches}).encode())
        out.close()
        gone = [r for r in self.runs if r not in runs]
        self.version, self.runs, self.batches = self.version + 1, runs, batches
        for name in [r[0] for r in gone] + [f"manifest={v}" for v in self._names("manifest=") if int(v) < self.version]:
            old, fs = self._fs(name)
            fs.delete(old, True)
            if name.startswith("run_"):
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _run(self, folder: str, buckets: int, keys: int) -> DataFrame:
        """A run as a bucketed table; another session's is made known to this one."""
        if not self.spark.catalog.tableExists(folder):
            self.spark.sql(f"CREATE TABLE {folder} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return self.spark.table(folder)

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """The full outer join of two runs: counts added, of two representatives the earlier one."""
        b = b.select("key", *[F.col(c).alias(f"_{c}") for c in ("copies", "first_id", "first_value")])
        keep = F.col("_first_id").isNull() | (F.col("first_id").isNotNull() & (F.struct("first_id", "first_value") <= F.struct("_first_id", "_first_value")))
        return a.join(b, "key", "full_outer").select(
            "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("_copies", F.lit(0))).alias("copies"),
            F.when(keep, F.col("first_id")).otherwise(F.col("_first_id")).alias("first_id"), F.when(keep, F.col("first_value")).otherwise(F.col("_first_value")).alias("first_value"),
        )

    def add(self, batch: DataFrame, ident: str, value: str, key: Column, name: str | None = None) -> Ledger:
        """Adds a batch: ``ident`` (integer) and ``value`` name its columns, ``key`` is the canonical key of a record.  A batch with a ``name``
        that is in already isn't added again."""
        if name is not None and name in self.batches:
            return self
        records = batch.select(key.alias("key"), F.col(ident).cast("long").alias("i"), F.col(value).alias("v")).where("key IS NOT NULL")
        least = F.min(F.when(F.col("i").isNotNull(), F.struct("i", "v"))).alias("f")
        counts = records.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), least).select("key", "copies", F.col("f.i").alias("first_id"), F.col("f.v").alias("first_value"))
        counts = written(counts)
        size, runs, met = counts.count(), list(self.runs), []
        while size and runs and runs[-1][2] <= 2 * size:
            met.append(runs.pop())
            size += met[-1][2]
        if size:
            out = counts
            for run in met:  # from the smallest to the largest
                out = self._merged(self._run(*run), out)
            buckets = self.least_buckets
            while buckets * BUCKET_KEYS < size:
                buckets *= 2
            if not met or met[-1][1] != buckets:
                out = out.repartition(buckets, "key")
            folder, seen = f"run_{uuid.uuid4().hex}", Observation()
            out = out.observe(seen, F.count(F.lit(1)).alias("n"))
            out.write.bucketBy(buckets, "key").sortBy("key").option("path", f"{self.path}/{folder}").saveAsTable(folder)
            runs.append([folder, buckets, seen.get["n"]])
        self._commit(runs, [*self.batches, *([name] if name is not None else [])])
        return self

    def records(self) -> DataFrame:
        """key, copies, first_id, first_value."""
        if not self.runs:
            return self.spark.createDataFrame([], SCHEMA)
        out = self._run(*self.runs[-1])
        for run in reversed(self.runs[:-1]):
            out = self._merged(self._run(*run), out)
        return out


def copies(batch: DataFrame, ident: str, key: Column, ledger: Ledger) -> DataFrame:
    """first_id, copy_id of all records of ``batch`` that are copies of an earlier record on the ledger."""
    several = ledger.records().where("copies > 1").select("key", "first_id", "copies")
    hot = hot_keys(several, "key", "copies")
    rows = batch.select(key.alias("key"), F.col(ident).alias("copy_id")).where("key IS NOT NULL")
    kind = dict(batch.dtypes)[ident]
    return join_to_keys(rows, several, "key", "copy_id", hot).where("copy_id <> first_id").select(F.col("first_id").cast(kind).alias("first_id"), "copy_id")


def keyed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type_string, key, quarter of all rows of type_references, by the quarter in which they were loaded; keys are made once."""
    rows = table(spark, sf_dir, "type_references")
    return written(rows.select("id", "type_string", written_key(F.col("type_string")).alias("key"), (F.year("loaded_at") * 4 + F.quarter("loaded_at")).alias("quarter")), partition_by=["quarter"])


def type_ledger(keyed: DataFrame) -> Ledger:
    """The ledger of all written types, fed a quarter at a time."""
    ledger = Ledger(keyed.sparkSession)
    for (quarter,) in sorted(map(tuple, keyed.select("quarter").distinct().collect()), key=lambda q: (q[0] is None, q[0] or 0)):
        ledger.add(keyed.where(F.col("quarter").eqNullSafe(F.lit(quarter))), "id", "type_string", F.col("key"), str(quarter))
    return ledger


def written_type_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found."""
    keyed = keyed_types(spark, sf_dir)
    return copies(keyed, "id", F.col("key"), type_ledger(keyed))


def written_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per written type: first_id, type_string, copies."""
    records = type_ledger(keyed_types(spark, sf_dir)).records()
    return records.select(F.col("first_id").cast("int").alias("first_id"), F.col("first_value").alias("type_string"), "copies")
