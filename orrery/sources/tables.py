"""Tables of a catalog directory: one Parquet file or folder per table.

A table that has been saved anew lies in a folder of its version; a small file beside it, ``<name>.current``, names the one that counts.
It is replaced by one atomic rename, so a reader sees the old table or the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def location(spark: SparkSession, directory: str, name: str) -> str:
    """The path of the version of a table that counts."""
    at, fs = _at(spark, f"{directory}/{name}.current")
    if not fs.exists(at):
        return f"{directory}/{name}.parquet"
    text = spark.sparkContext._jvm.java.util.Scanner(fs.open(at), "UTF-8")
    folder = text.next()
    text.close()
    return f"{directory}/{folder}"


def exists(spark: SparkSession, directory: str, name: str) -> bool:
    at, fs = _at(spark, location(spark, directory, name))
    return fs.exists(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(location(spark, sf_dir, name))


def replace(df: DataFrame, directory: str, name: str) -> None:
    """A new version of a table, which counts once it is complete.  The version before it stays for those that still read it; older ones go."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    home, fs = _at(spark, directory)
    versions = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    numbers = sorted(int(v.split(".")[-2]) for v in versions if v.startswith(f"{name}.") and v.endswith(".version") and v.split(".")[-2].isdigit())
    now = location(spark, directory, name).rsplit("/", 1)[-1]
    folder = f"{name}.{(numbers[-1] if numbers else 0) + 1}.version"
    df.write.parquet(f"{directory}/{folder}")
    new, _ = _at(spark, f"{directory}/{name}.current.{folder}")
    out = fs.create(new, True)
    out.write(folder.encode())
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(home.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if home.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, _at(spark, f"{directory}/{name}.current")[0], options)
    for number in numbers:
        if (old := f"{name}.{number}.version") not in (now, folder):
            fs.delete(_at(spark, f"{directory}/{old}")[0], True)
    if numbers and now != f"{name}.parquet" and fs.exists(_at(spark, f"{directory}/{name}.parquet")[0]):
        fs.delete(_at(spark, f"{directory}/{name}.parquet")[0], True)
