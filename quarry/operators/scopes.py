"""What the names of script files mean: each use meets the declarations of the scopes around it, and the nearest counts.

Input are the names of ``sources/scripts.py``.  A scope and a name are a key, so that files, and uses in a file, are
resolved side by side; names without a declaration are global, or missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECLARES = "kind IN ('definition', 'import')"


def declarations(names: DataFrame) -> DataFrame:
    """(file_path, scope, name, declared, exported): the first declaration of a name in a scope; later ones are the same symbol."""
    return (
        names.where(_DECLARES)
        .groupBy("file_path", F.get("chain", F.lit(0)).alias("scope"), "name")
        .agg(F.min(F.struct("at", "line", "column", "how")).alias("declared"), F.max("exported").alias("exported"))
    )


def bound(names: DataFrame) -> DataFrame:
    """Reads and writes (file_path, at, name, line, column, kind) with what they mean: ``declared``, null if nothing does."""
    uses = names.where(f"NOT {_DECLARES}").select("file_path", "at", "name", "line", "column", "kind", F.posexplode("chain").alias("near", "scope"))
    met = uses.join(declarations(names).drop("exported"), ["file_path", "scope", "name"], "left")
    nearest = F.min(F.when(F.col("declared").isNotNull(), F.struct("near", "declared")))
    return met.groupBy("file_path", "at", "name", "line", "column", "kind").agg(nearest.alias("m")).select(
        "file_path", "at", "name", "line", "column", "kind", F.col("m.declared").alias("declared")
    )


def references(names: DataFrame, name: str | None = None) -> DataFrame:
    """(file_path, name, line, column, kind, declared_line, declared_column): definitions, and uses that mean them."""
    if name is not None:
        names = names.where(F.col("name") == name)
    own = declarations(names).select("file_path", "name", "declared.line", "declared.column", F.lit("definition").alias("kind"), "declared")
    used = bound(names).where("declared IS NOT NULL").select("file_path", "name", "line", "column", "kind", "declared")
    return own.union(used).select(
        "file_path", "name", "line", "column", "kind", F.col("declared.line").alias("declared_line"), F.col("declared.column").alias("declared_column")
    )


def symbols(names: DataFrame) -> DataFrame:
    """(file_path, name, how, line, column, exported, reference_count, mutated) of each declared name."""
    key = ["file_path", "declared"]
    counts = bound(names).where("declared IS NOT NULL").groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == "write").alias("written")
    )
    return declarations(names).join(counts, key, "left").select(
        "file_path", "name", "declared.how", "declared.line", "declared.column", "exported",
        F.coalesce("n", F.lit(0)).cast("long").alias("reference_count"), F.coalesce("written", F.lit(False)).alias("mutated"),
    )


def unresolved(names: DataFrame) -> DataFrame:
    """(file_path, name, uses, first_line): names that no scope around them declares."""
    return bound(names).where("declared IS NULL").groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("uses"), F.min("line").alias("first_line"))
