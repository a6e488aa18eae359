"""Type hierarchies: names with supertypes, walked up or down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import reach


def hierarchy(supers: DataFrame, roots: DataFrame, down: bool = True, depth: int = 50) -> DataFrame:
    """(root, node, depth) over edges (name, supertype): subtypes of each root, or its supertypes."""
    edges = supers.select(F.col("name").alias("src"), F.col("supertype").alias("dst"))
    if not down:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(edges, roots, depth or 50)
