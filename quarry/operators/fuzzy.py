"""Fuzzy name search: a cheap filter in the JVM, Jaro-Winkler on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.udfs import jaro_winkler
from quarry.operators.rank import top_k
from quarry.operators.sizes import batch


def fuzzy(symbols: DataFrame, queries: DataFrame, least: float = 0.8, k: int = 10) -> DataFrame:
    """(query_id, name, score, rank): distinct names with a query's first two characters, by similarity.

    Names are compared once however many symbols share them.
    """
    names = symbols.select("name").distinct()
    q = queries.select("query_id", F.lower("query").alias("ql"))
    near = names.join(batch(q), F.contains(F.lower("name"), F.substring("ql", 1, 2)))
    scored = near.withColumn("score", F.round(jaro_winkler(F.lower("name"), F.col("ql")) * 100, 4))
    return top_k(scored.where(F.col("score") >= least * 100), k, "score", "name").select("query_id", "name", "score", "rank")
