"""Results and catalog rows as they arrive.

An extension of our own: what the pipeline does in one run, done per micro-batch.  ``foreachBatch`` gives each batch at least
once; the upsert makes that exactly once in its effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.operators.catalog import save, upsert
from orrery.sources.tables import exists, table


def arriving(spark: SparkSession, directory: str, schema) -> DataFrame:
    """Rows of Parquet files as they come into a directory."""
    return spark.readStream.schema(schema).parquet(directory)


def keep_latest(stream: DataFrame, directory: str, name: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table with one row per key, the last by ``order``, up to date with a stream; ends when what is there is read."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        now = table(spark, directory, name) if exists(spark, directory, name) else batch.limit(0)
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        save(upsert(now, last, keys, F.col(order)), directory, name)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loads_per_window(stream: DataFrame, at: str, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """begin, n: rows per window of time, with rows that come later than the watermark left out of windows that are closed."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    return timed.groupBy(F.window(at, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), "n")
