"""A watcher of a project's files: each look lists them as Spark does, and what differs from the look before are events.

What was seen is a bucketed table by path, so that a look rewrites only the buckets of what changed, and a watcher that
starts again goes on from the last look.  Events are JSON lines, which ``streaming.ingest.file_events`` reads as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import buckets
from quarry.sources.code import project_files
from quarry.storage import written

#: Milliseconds for which a file has to be left alone before a change counts.
SETTLE_MS = 300


def seen(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(path, size_bytes, mtime_ms) as of the last look, or of the one before a number."""
    held = buckets.latest(spark, folder, before)
    if held is None:
        return spark.createDataFrame([], "path string, size_bytes long, mtime_ms long")
    return held.select("path", "size_bytes", "mtime_ms")


def look(spark: SparkSession, root: str, folder: str, events: str, number: int, now_ms: int, settle_ms: int = SETTLE_MS, more: tuple[str, ...] = ()) -> DataFrame:
    """The events (batch, path, kind, at) of one look, which are in ``events`` then; looks are numbered upwards.

    A file that was written less than ``settle_ms`` ago waits for a later look, and so many writes in a row are one event.
    Contents are not read.  Events are written before what was seen is: a look that fails on the way and is run again
    gives the same events once more, under the same number, and none is lost.
    """
    now = project_files(spark, root, more).select(F.col("relative_path").alias("path"), "size_bytes", "mtime_ms", F.lit(True).alias("here"))
    old = seen(spark, folder, number).select("path", F.col("size_bytes").alias("was_bytes"), F.col("mtime_ms").alias("was_ms"), F.lit(True).alias("had"))
    changed = (F.col("size_bytes") != F.col("was_bytes")) | (F.col("mtime_ms") != F.col("was_ms"))
    kind = F.when(F.col("here").isNull(), "deleted").when(F.col("mtime_ms") > now_ms - settle_ms, None).when(F.col("had").isNull(), "created").when(changed, "modified")
    both = now.join(old, "path", "full").withColumn("kind", kind).where("kind IS NOT NULL")
    changes = written(both.select("path", "kind", F.coalesce("size_bytes", "was_bytes").alias("size_bytes"), F.coalesce("mtime_ms", "was_ms").alias("mtime_ms")), "watcher")
    at = F.timestamp_millis(F.lit(now_ms).cast("long"))
    rows = changes.select(F.lit(number).cast("long").alias("batch"), "path", "kind", at.alias("at"))
    if not changes.isEmpty():
        rows.write.mode("overwrite").json(f"{events}/look-{number}")
        buckets.merge(changes.withColumn("deleted", F.col("kind") == "deleted").drop("kind"), folder, "path", number)
    return rows
