"""Tables in hash buckets that are kept up to date: a change rewrites the buckets that it touches, and nothing else.

A version of a table is a folder ``v=<number>`` with the buckets that were touched, whole; a bucket's rows are those
of its last version.  Writing a version again gives the same, so that a batch can be retried.  Keys that are gone stay
as marks, so that an emptied bucket does not fall back to an older version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import written

BUCKETS = 64
#: Rows of a bucket in a file, about: a bucket of more is several tasks' work.
FILE_ROWS = 20_000


def _write(rows: DataFrame, key: str, path: str, buckets: int) -> None:
    """Rows with their bucket, which goes to as many files as it has stretches of ``FILE_ROWS`` rows on average."""
    files = 1 + rows.count() // (buckets * FILE_ROWS)
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(files)))
    dealt.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def versions(spark: SparkSession, folder: str, before: int | None) -> DataFrame | None:
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:  # no version yet
        return None
    return rows if before is None else rows.where(F.col("v") < before)


def _last(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """All rows of the last versions, with their bucket, marks included."""
    rows = versions(spark, folder, before)
    if rows is None:
        return None
    last = rows.groupBy("bucket").agg(F.max("v").alias("v")).collect()  # a row a bucket
    if not last:
        return None
    return rows.where(reduce(lambda a, b: a | b, [(F.col("bucket") == r.bucket) & (F.col("v") == r.v) for r in last]))  # prunes partitions


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The rows of a table, as of before a version if one is given, or None if it has none yet."""
    rows = _last(spark, folder, before)
    return None if rows is None else rows.where(~F.col("deleted")).drop("deleted", "v", "bucket")


def drop_before(spark: SparkSession, folder: str, version: int) -> None:
    """Removes the versions before one that stands for all of them."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < version:
            fs.delete(status.getPath(), True)


def compact(spark: SparkSession, folder: str, version: int, key: str) -> None:
    """All rows that count as one version, without marks, which stands for those before it."""
    rows = _last(spark, folder, version)
    if rows is not None:
        live = written(rows.where(~F.col("deleted")).drop("v"), "compacted")
        _write(live, key, f"{folder}/v={version}", BUCKETS)
        drop_before(spark, folder, version)


def merge(changes: DataFrame, folder: str, key: str, version: int, buckets: int = BUCKETS) -> None:
    """Puts all rows of the changes' keys in place of the older ones; rows with ``deleted`` only mark their key as gone."""
    spark = changes.sparkSession
    changes = changes.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    old = _last(spark, folder, version)
    if old is not None:
        old = old.where(F.col("bucket").isin(touched)).drop("v").join(changes.select(key).distinct(), key, "left_anti")
        changes = changes.unionByName(old, allowMissingColumns=True)
    _write(changes, key, f"{folder}/v={version}", buckets)
