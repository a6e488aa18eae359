"""Retrieval quality, call-graph accuracy and contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import vector
from quarry.operators.sizes import small
from quarry.operators.telemetry import ratio


def retrieval(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(queries, mrr, acc1, acc3, acc5) of ranked results (query_id, key, rank) against (query_id, key)."""
    hit = results.join(labels, ["query_id", "key"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    rows = labels.select("query_id").distinct().join(hit, "query_id", "left")
    acc = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"acc{k}")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        acc(1),
        acc(3),
        acc(5),
    )


def recall_at(results: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of a query's labels among its first k results."""
    hit = results.where(F.col("rank") <= k).select("query_id", "key", F.lit(1).alias("hit"))
    return labels.join(hit, ["query_id", "key"], "left").groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("recall")
    )


def prf(found: DataFrame, truth: DataFrame, keys: list[str], beta: float = 1.0) -> DataFrame:
    """(tp, fp, fn, precision, recall, f): micro, over sets of keys."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = a.join(b, keys, "full")
    sums = both.agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("f").isNull()).alias("fn"),
    )
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = sums.withColumn("p", p).withColumn("r", r)
    f = (1 + beta * beta) * F.col("p") * F.col("r") / F.nullif(beta * beta * F.col("p") + F.col("r"), F.lit(0.0))
    return rows.select(
        "tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"),
        F.round(F.coalesce(f, F.lit(0.0)), 6).alias("f"),
    )


def tails(path):
    """All ends of a path that start at a component."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def by_suffix(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, key, rank, label): found symbols (query_id, name, file_path, rank) with the label that they meet, if any.

    A label (query_id, name, suffix) is met by its name in a file whose path ends like it, at a component.
    """
    rows = found.withColumn("key", F.concat("file_path", F.lit(":"), "name"))
    met = (
        rows.select("query_id", "name", "key", F.explode(tails(F.col("file_path"))).alias("suffix"))
        .join(labels.select("query_id", "name", "suffix").distinct(), ["query_id", "name", "suffix"])
        .groupBy("query_id", "key")
        .agg(F.max(F.struct(F.length("suffix"), F.concat("suffix", F.lit(":"), "name").alias("label"))).alias("m"))
    )
    return rows.join(met, ["query_id", "key"], "left").select("query_id", "key", "rank", F.col("m.label").alias("label"))


def suffix_prf(found: DataFrame, labels: DataFrame, beta: float = 1.0) -> DataFrame:
    """``prf`` of found symbols against labels by path suffix: a found one counts as the label that it meets."""
    rows = by_suffix(found, labels).select("query_id", F.coalesce("label", "key").alias("key"))
    truth = labels.select("query_id", F.concat("suffix", F.lit(":"), "name").alias("key"))
    return prf(rows, truth, ["query_id", "key"], beta)


def normalized(text):
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def runs(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, h): the distinct runs of ``size`` normalised words of each text, by a hash of the words' hashes."""

    def windows(h):
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) >= size, F.array_distinct(each))

    words = F.split(normalized(F.coalesce("text", F.lit(""))), " ")
    return df.select(key, F.explode(T.let(F.transform(words, lambda w: F.xxhash64(w)), windows)).alias("h"))


def contamination(items: DataFrame, corpus: DataFrame, size: int = 12) -> DataFrame:
    """(item_id, docs): documents that share a run of words with an item, as they stand or normalised.

    Items are few: their runs are counted, and sent to the documents if they fit, so that these are not shuffled.
    """
    hits = runs(corpus, "doc_id", size).join(small(runs(items, "item_id", size)), "h").select("item_id", "doc_id").distinct()
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


def overlaps(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(item_id, exact, normalised): documents whose text is an item's, as it stands and normalised, by SHA-256."""

    def count(name: str, text) -> DataFrame:
        a = queries.select("item_id", F.sha2(text, 256).alias("h"))
        b = corpus.select("doc_id", F.sha2(text, 256).alias("h"))
        return b.join(small(a), "h").groupBy("item_id").agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("long")
    rows = queries.select("item_id").join(count("exact", F.col("text")), "item_id", "left")
    rows = rows.join(count("normalised", normalized(F.col("text"))), "item_id", "left")
    return rows.select("item_id", F.coalesce("exact", zero).alias("exact"), F.coalesce("normalised", zero).alias("normalised"))


def near_items(queries: DataFrame, corpus: DataFrame, least: float = 0.9) -> DataFrame:
    """(query_id, id, score): rows of the corpus (id, embedding) with a cosine to a query (query_id, vector) at or above a limit."""
    return vector.reaching(corpus, queries, least)


def latency(rows: DataFrame) -> DataFrame:
    """Mean and harness p95 per group (group, ms): the percentile by rank, over the counts of a group's distinct values.

    A group that holds most rows is counted where its rows lie; only its distinct values meet.
    """
    counts = rows.groupBy("group", "ms").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("group").orderBy("ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum("c").over(by)).withColumn("n", F.sum("c").over(Window.partitionBy("group")))
    at = F.greatest(F.ceil(F.col("n") * 0.95), F.lit(1))
    here = (F.col("upto") >= at) & (F.col("upto") - F.col("c") < at)
    mean = F.sum(F.col("ms") * F.col("c")) / F.sum(F.when(F.col("ms").isNotNull(), F.col("c")))
    return ranked.groupBy("group").agg(F.round(mean, 4).alias("avg_ms"), F.max(F.when(here, F.col("ms"))).alias("p95_ms"))
