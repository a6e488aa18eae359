"""Helpers shared by the training-data operators: tables, row numbers, text prep, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import new_folder, shared_dir, written  # noqa: F401 - the operators take them from here

#: White space that separates words, as a regular-expression class (kept ASCII-only on purpose).
SPACE = r"[\x20\x09-\x0D]"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def located(docs: DataFrame) -> DataFrame:
    """(doc: a row of ``docs`` as a struct, file, row): the numbers tell it from all others in every later reading.

    They are the hash of its file's path and its place in the file.  A frame that is not just a reading of
    Parquet files is written first, so that its rows cannot change between two readings.
    """
    plain = docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation")
    if not (plain and all(f.endswith(".parquet") for f in docs.inputFiles())):
        docs = written(docs, "rows")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Inside a higher-order function a column that the optimizer inlines is evaluated again for each
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def running(values: Column, kind: str, zero, merge) -> Column:
    """What all values before each one merge to, as an array; ``zero`` before the first.

    Values are taken in chunks, as an array that grows by one element is copied each time.
    """
    chunk, start = 512, F.lit(zero).cast(kind)
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, v: Column) -> Column:
        return F.struct(merge(acc["at"], v).cast(kind).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def of_values(values: Column) -> Column:
        def outer(acc: Column, c: Column) -> Column:
            part = F.aggregate(F.slice(values, c * chunk + 1, F.lit(chunk)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return let(part, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / chunk).cast("int"))
        first = F.struct(start.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(values) > 0, F.flatten(F.aggregate(chunks, first, outer, lambda acc: acc["out"]))).otherwise(none)

    return let(values, of_values)


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _distinct_state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as (node, component = smallest member).

    Alternates large-star and small-star steps until the edge set no longer changes: every node then
    points straight at the smallest id of its component.  Each step is an aggregation with map-side
    partial minima and an equi-join that adaptive execution may split, so a hub with very many edges
    does not have to fit a task.  Only two numbers per round reach the driver.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    e = (
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where("hi <> lo")
        .distinct()
        .checkpoint()
    )
    state = _distinct_state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("x")
        )
        e2 = small.select("x.hi", "x.lo").where("hi <> lo").distinct().checkpoint()
        after = _distinct_state(e2)
        e, done = e2, after == state
        state = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("lo").alias("node")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )
