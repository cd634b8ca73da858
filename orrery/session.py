"""A session with the settings the engine expects; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()
