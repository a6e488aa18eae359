"""A full-text index that is kept: postings by term, read by the terms that a query asks for.

``postings``: (term, id, tf, dl, flags of the document), in folders by version, use and first character, sorted by
term within files, so that a query reads the folders of its terms' first characters, and in them the row groups
that may hold them.  There are two uses: weighted fields for BM25, and plain tokens for searches by prefix.
``documents``: what each document has, with its terms, in hash buckets.  ``statistics``: numbers and lengths.

A change brings a version with the postings of the changed documents alone: new ones, and marks for the terms that
they had before, which the table of documents tells.  Of a term and document the last version counts.
``compact`` makes one version of all; a version that is written again is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources import buckets
from quarry.storage import written

FLAGS = ("is_test", "is_generated", "exported")
_TERM = "array<struct<term:string,tf:double>>"


def lead(term: Column) -> Column:
    """The folder of a term: its first character, if that is a plain one."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("[a-z0-9_]"), first).otherwise("~")


def prefix_tokens(*texts: Column) -> Column:
    split = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    return F.concat(*[split(c) for c in texts])


_WORD = re.compile("[a-z0-9_]+")


def _terms(lowered: str) -> Iterator[str]:
    """The tokens of ``functions.text.tokens`` in a text that is in lower case."""
    for run in _WORD.findall(lowered):
        if len(run) >= 2:
            yield run
            if "_" in run:
                yield from (p for p in run.split("_") if len(p) >= 2)


def _counted(weights: list[float]):
    """Adds (bm25_dl, bm25, prefix_dl, prefix): each term of a row once, with its weighted frequency in all fields."""

    def lists(rows: list[dict[str, float]]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        terms = pa.array([t for r in rows for t in r], pa.string())
        tf = pa.array([x for r in rows for x in r.values()], pa.float64())
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, tf], ["term", "tf"]))

    def run(batches):
        n = len(weights)
        for b in batches:
            bm25, bm25_dl, plain = [], [], []
            for texts in zip(*[b.column(i).to_pylist() for i in range(n)], strict=True) if n else [()] * b.num_rows:
                row, length = {}, 0.0
                for text, w in zip(texts, weights, strict=True):
                    for t in _terms(text):
                        row[t] = row.get(t, 0.0) + w
                        length += w
                bm25.append(row)
                bm25_dl.append(length)
            words = b.column(n).to_pylist()
            for found in words:
                row = {}
                for t in found or ():
                    row[t] = row.get(t, 0.0) + 1.0
                plain.append(row)
            made = {
                "bm25_dl": pa.array(bm25_dl, pa.float64()), "bm25": lists(bm25),
                "prefix_dl": pa.array([None if x is None else float(len(x)) for x in words], pa.float64()), "prefix": lists(plain),
            }
            yield pa.RecordBatch.from_arrays([*b.columns[n + 1 :], *made.values()], [*b.schema.names[n + 1 :], *made])

    return run


def entries(docs: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, flags, bm25_dl, bm25, prefix_dl, prefix): a document's terms of both uses, each once, with their frequencies."""
    flags = [F.col(c) if c in docs.columns else F.lit(None).cast("boolean").alias(c) for c in FLAGS]
    have = {f: w for f, w in fields.items() if f in docs.columns}
    texts = [F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f"text_{f}") for f in have]
    rows = docs.select(*texts, prefix_tokens(F.col("name"), F.col("name_path"), F.col("signature")).alias("words"), "id", *flags)
    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *FLAGS))
    return rows.mapInArrow(_counted(list(have.values())), f"{kept}, bm25_dl double, bm25 {_TERM}, prefix_dl double, prefix {_TERM}")


def _postings(rows: DataFrame, deleted: bool) -> DataFrame:
    """(use, lead, term, id, tf, dl, flags, deleted) of entries."""
    out = []
    for use in ("bm25", "prefix"):
        each = rows.select("id", *FLAGS, F.col(f"{use}_dl").alias("dl"), F.explode(use).alias("e")).select("id", *FLAGS, "dl", "e.term", "e.tf")
        out.append(each.withColumn("use", F.lit(use)))
    return reduce(DataFrame.unionByName, out).withColumn("lead", lead(F.col("term"))).withColumn("deleted", F.lit(deleted))


def _write(rows: DataFrame, folder: str, version: int) -> None:
    sorted_rows = rows.repartitionByRange("use", "lead", "term", "id").sortWithinPartitions("use", "lead", "term", "id")
    sorted_rows.write.mode("overwrite").partitionBy("use", "lead").parquet(f"{folder}/postings/v={version}")


def _total(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.lit(sign).alias("n"), (F.col("bm25_dl") * sign).alias("bm25_dl"), (F.col("prefix_dl") * sign).alias("prefix_dl"))


def merge(docs: DataFrame, folder: str, version: int, fields: dict[str, float], gone: DataFrame | None = None) -> None:
    """Puts documents into an index, in place of those with their ids; ``gone`` (id) takes others out."""
    spark = docs.sparkSession
    new = written(entries(docs, fields).withColumn("deleted", F.lit(False)), "entries")
    kept = buckets.latest(spark, f"{folder}/documents", version)
    changes, total = new, _total(new, 1)
    rows = _postings(new, False)
    if kept is not None:
        ids = new.select("id") if gone is None else new.select("id").unionAll(gone.select("id"))
        old = written(kept.join(ids.distinct(), "id"), "entries-before")
        marks = _postings(old, True).join(rows.select("use", "term", "id"), ["use", "term", "id"], "left_anti")
        rows, total = rows.unionByName(marks), total.unionAll(_total(old, -1))
        out = old.join(new, "id", "left_anti").withColumn("deleted", F.lit(True))
        changes = changes.unionByName(out)
    _write(rows, folder, version)
    before = _versions(spark, folder, "statistics")
    if before is not None:
        total = total.unionAll(before.where(F.col("v") == before.where(F.col("v") < version).agg(F.max("v")).first()[0]).select("n", "bm25_dl", "prefix_dl"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "bm25_dl", "prefix_dl")]
    total.agg(*sums).write.mode("overwrite").parquet(f"{folder}/statistics/v={version}")
    buckets.merge(changes, f"{folder}/documents", "id", version)


def _versions(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    return buckets.versions(spark, f"{folder}/{name}", None)


def statistics(spark: SparkSession, folder: str, use: str) -> DataFrame:
    """One row (n, avgdl): all documents, and their mean length for a use."""
    rows = _versions(spark, folder, "statistics")
    last = rows.agg(F.max_by(F.struct("n", f"{use}_dl"), "v").alias("s"))
    return last.select("s.n", F.try_divide(F.col(f"s.{use}_dl"), F.col("s.n")).alias("avgdl"))


def read(spark: SparkSession, folder: str, use: str, terms: list[str], prefix: bool = False) -> DataFrame:
    """(term, id, tf, dl, flags) of a query batch's terms, or of terms that start with them."""
    rows = _versions(spark, folder, "postings")
    if rows is None:  # no document has a term
        return spark.createDataFrame([], "term string, id long, tf double, dl double, is_test boolean, is_generated boolean, exported boolean")
    rows = rows.where(F.col("use") == use)
    leads = sorted({t[0] if t[0] in "abcdefghijklmnopqrstuvwxyz0123456789_" else "~" for t in terms if t})
    match = reduce(lambda a, t: a | F.col("term").startswith(t), [t for t in terms if t], F.lit(False)) if prefix else F.col("term").isin(*terms)
    rows = rows.where(F.col("lead").isin(*leads) & match)
    state = F.struct("tf", "dl", *FLAGS, "deleted")
    last = rows.groupBy("term", "id").agg(F.max_by(state, "v").alias("s")).select("term", "id", "s.*")
    return last.where(~F.col("deleted")).drop("deleted")


def compact(spark: SparkSession, folder: str, version: int) -> None:
    """All that counts as one version, which stands for those before it."""
    rows = _versions(spark, folder, "postings").where(F.col("v") < version)
    state = F.struct("tf", "dl", *FLAGS, "deleted")
    last = rows.groupBy("use", "lead", "term", "id").agg(F.max_by(state, "v").alias("s")).select("use", "lead", "term", "id", "s.*")
    _write(written(last.where(~F.col("deleted")), "compacted"), folder, version)
    stats = _versions(spark, folder, "statistics")
    written(stats.orderBy(F.col("v").desc()).limit(1).drop("v"), "compacted-statistics").write.mode("overwrite").parquet(f"{folder}/statistics/v={version}")
    buckets.drop_before(spark, f"{folder}/postings", version)
    buckets.drop_before(spark, f"{folder}/statistics", version)
