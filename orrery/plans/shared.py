"""Helpers for plans that must hold at any size: the shared folder, cutting lineage, hot keys, running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs on one
    machine (tests)."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not (own := getattr(sc, "_orrery_dir", None)):
        sc._orrery_dir = own = "file://" + tempfile.mkdtemp(prefix="orrery-")
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a checkpoint in the shared folder, so that neither plans grow nor a lost executor matters.

    A checkpoint keeps the estimated size of the plan it was made from.  In a loop of joins estimates multiply, and the planner soon spends
    all its time on numbers of millions of digits; so rows whose estimate is beyond all reason are taken up anew, without one, and
    adaptive execution goes by the sizes it measures.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    forget_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    done = df.checkpoint(eager=True)
    if int(str(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 62:
        return done
    plain = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, spark)


def cut_and_count(df: DataFrame, which: str) -> tuple[DataFrame, int]:
    """:func:`cut`, and how many of the rows fulfil ``which``, counted on the way."""
    seen = Observation()
    done = cut(df.observe(seen, F.count_if(F.expr(which)).alias("n")))
    return done, seen.get["n"]


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder when the driver's Python ends in good order; results may read it until then."""
    sc = spark.sparkContext
    if (mine := getattr(sc, "_orrery_tables", None)) is None:
        sc._orrery_tables = mine = []

        def clean() -> None:
            try:
                for p in mine:
                    at = sc._jvm.org.apache.hadoop.fs.Path(p)
                    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            except Exception:  # the session has ended before
                pass

        atexit.register(clean)
    if path not in mine:
        mine.append(path)


def written(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows read from a Parquet table in the shared folder (compact and columnar, unlike a checkpoint)."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/orrery-{uuid.uuid4().hex}"
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, key: str, n: str, shares: int = 64, least: int = 0) -> list:
    """Keys that hold more than 1/``shares`` of all rows, and ``least`` rows: fewer than ``shares``, so they may go to the driver."""
    seen = Observation()
    top = counts.observe(seen, F.sum(n).alias("n")).where(F.col(key).isNotNull()).select(key, n).orderBy(F.desc(n)).limit(shares).collect()
    total = seen.get["n"] or 0
    return [k for k, m in top if m * shares > total and m >= least]


def salt(key: Column, hot: list, spread: Column, ways: int) -> Column:
    """0, but for hot keys one of ``ways`` numbers made from ``spread`` (a column that differs between their rows)."""
    return F.when(key.isin(*hot), F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)


def salted(per_key: DataFrame, key: str, hot: list, ways: int) -> DataFrame:
    """``per_key`` with a column ``_salt``: rows of hot keys once for each salt."""
    if not hot:
        return per_key.withColumn("_salt", F.lit(0))
    every = F.when(F.col(key).isin(*hot), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    return per_key.withColumn("_salt", F.explode(every))


def join_to_keys(rows: DataFrame, per_key: DataFrame, key: str, spread: str, hot: list, how: str = "inner", ways: int = 64, merge: bool = True) -> DataFrame:
    """``rows`` joined with ``per_key`` by a sort-merge join whose hot keys are spread over ``ways`` tasks.

    Without hot keys, and not asked to ``merge``, it is a plain join, whose kind adaptive execution chooses by measured sizes.
    """
    if not hot and not merge:
        return rows.join(per_key, key, how)
    left = rows.withColumn("_salt", salt(F.col(key), hot, F.col(spread), ways))
    return left.hint("merge").join(salted(per_key, key, hot, ways), [key, "_salt"], how).drop("_salt")


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: within ``group``, the sum of ``value`` (a long) over all rows before this one in ``order``.

    No group goes through one task: rows are range-partitioned by group and order, each partition is summed, and the sums of
    the partitions before are added.  Those sums are one row per partition and group that meets it: fewer than the number of
    partitions plus that of groups.
    """
    pid = "_pid"
    laid = written(df.repartitionByRange(*[F.col(c) for c in (group, *order)]).withColumn(pid, F.spark_partition_id()))
    sums = laid.groupBy(pid, group).agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy(pid).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    local = F.coalesce(F.sum(value).over(W.partitionBy(pid, group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return laid.withColumn("_local", local).join(before, [pid, group]).withColumn(out, (F.col("_local") + F.col("_base")).cast(T.LongType())).drop("_local", "_base", pid)


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3... in ``order`` (which must be total), without sorting everything in one task.

    One number per partition goes through the driver.
    """
    laid = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in laid.groupBy("_pid").count().collect())
    before, first = [], 0
    for pid, n in sizes:
        before.append((pid, first))
        first += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_pid int, _before bigint"))  # one row per partition
    return laid.join(offsets, "_pid").withColumn(out, (F.row_number().over(W.partitionBy("_pid").orderBy(*order)) + F.col("_before")).cast("int")).drop("_pid", "_before")
