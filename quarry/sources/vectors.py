"""A kept store of vectors, a row a symbol: what an index run changes is written, and only what is new is embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import buckets
from quarry.storage import written


def rows(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(id, file_path, text_hash, embedding): what the store holds, as of before a version if one is given."""
    held = buckets.latest(spark, folder, before)
    if held is None:
        return spark.createDataFrame([], "id long, file_path string, text_hash string, embedding array<float>")
    return held.select("id", "file_path", "text_hash", "embedding")


def reconcile(symbols: DataFrame, folder: str, version: int, embed: Callable[[DataFrame], DataFrame], count: int = buckets.BUCKETS) -> dict[str, int]:
    """Brings the store to a project's symbols (id, file_path, text), and says how many rows each action took.

    A symbol with the text that its vector was made from is reused, and not written; if it moved to another file, it
    is written with the vector that it has.  All others go to ``embed``, (id, text) to (id, embedding), and those
    that are gone are deleted.  Of rows with one id the first by file and text counts; a null text is an empty one,
    rows without an id are left out.  A version that is run again gives the same.
    """
    spark = symbols.sparkSession
    one = symbols.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("text", F.lit("")).alias("text"))).alias("s"))
    new = one.select("id", "s.*", F.sha2("s.text", 256).alias("text_hash"))
    old = rows(spark, folder, version).select("id", F.col("file_path").alias("was_in"), F.col("text_hash").alias("was"), F.col("embedding").alias("held"))
    action = (
        F.when(F.col("text_hash").isNull(), "delete")
        .when(F.col("was").isNull() | (F.col("was") != F.col("text_hash")), "embed")
        .when(F.col("was_in") != F.col("file_path"), "move")
        .otherwise("reuse")
    )
    todo = written(new.join(old, "id", "full").withColumn("action", action), "vector-actions")
    made = todo.where("action = 'embed'").select("id", "file_path", "text_hash").join(embed(todo.where("action = 'embed'").select("id", "text")), "id")
    moved = todo.where("action = 'move'").select("id", "file_path", "text_hash", F.col("held").alias("embedding"))
    gone = todo.where("action = 'delete'").select("id", F.col("was_in").alias("file_path"), F.col("was").alias("text_hash"), F.col("held").alias("embedding"))
    no = F.lit(False)
    changes = made.withColumn("deleted", no).unionByName(moved.withColumn("deleted", no)).unionByName(gone.withColumn("deleted", ~no))
    buckets.merge(written(changes, "vector-changes"), folder, "id", version, count)
    return {r.action: r.n for r in todo.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most


def delete_files(files: DataFrame, folder: str, version: int, count: int = buckets.BUCKETS) -> None:
    """Deletes the vectors of files (file_path)."""
    held = rows(files.sparkSession, folder, version).join(files.select("file_path").distinct(), "file_path", "left_semi")
    buckets.merge(written(held.withColumn("deleted", F.lit(True)), "vector-changes"), folder, "id", version, count)
