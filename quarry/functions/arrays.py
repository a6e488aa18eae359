"""Array columns: running values in work that is linear in the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import let

#: Elements of a chunk: an array that grows by one element is copied each time, so it grows in chunks.
CHUNK = 512


def running(values: Column, kind: str, zero: Column, merge) -> Column:
    """What all values before each one merge to, as an array; ``zero`` before the first."""
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, v: Column) -> Column:
        return F.struct(merge(acc["at"], v).cast(kind).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def of_values(values: Column) -> Column:
        def outer(acc: Column, c: Column) -> Column:
            part = F.aggregate(F.slice(values, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return let(part, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

        chunks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))
        first = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(values) > 0, F.flatten(F.aggregate(chunks, first, outer, lambda acc: acc["out"]))).otherwise(none)

    return let(values, of_values)
