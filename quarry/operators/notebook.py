"""Notes with headers, their ages and states, and the work that agents have registered, as tables that are kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lookup

#: Seconds after which a note is stale.
STALE = 14 * 86400


def read(notes: DataFrame, name: str | None = None) -> DataFrame:
    """Notes (note, text) with header and body; one of them if a name is given."""
    rows = notes.where(F.col("note") == name) if name is not None else notes
    f = T.frontmatter(F.col("text"))
    return rows.withColumn("header", f["header"]).withColumn("body", f["body"])


def listed(notes: DataFrame, now: Column, kind: str | None = None, archived: bool = False) -> DataFrame:
    """Notes (note, updated_at) with age in seconds and whether they are stale; live ones or archived ones, of a kind if one is given."""
    rows = notes
    if "archived" in notes.columns:
        rows = rows.where(F.col("archived") == archived)
    elif archived:
        rows = rows.limit(0)
    rows = rows.where(F.col("kind") == kind) if kind is not None else rows
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return rows.withColumn("age", age).withColumn("stale", age > STALE)


def policy(notes: DataFrame, name: str = "policy") -> DataFrame:
    """The note of that name, without its header."""
    return read(notes, name).select("note", "body")


def register(agents: DataFrame, new: DataFrame) -> DataFrame:
    """Agents (session, ..., expires_at) with new registrations in place of older ones of the same session."""
    return lookup.upsert(agents, new, "session")


def claim(claims: DataFrame, session: str, paths: list[str]) -> DataFrame:
    """Claims (session, paths) with a session's paths added; a session without claims gets a row."""
    more = F.array(*[F.lit(p) for p in paths])
    mine = F.col("session") == session
    have = claims.withColumn("paths", F.when(mine, F.array_sort(F.array_union("paths", more))).otherwise(F.col("paths")))
    if claims.where(mine).isEmpty():
        row = claims.sparkSession.createDataFrame([(session, sorted(set(paths)))], "session string, paths array<string>")
        have = have.unionByName(row)
    return have


def release(claims: DataFrame, session: str, paths: list[str]) -> DataFrame:
    """Claims without a session's paths; a session with none left has no row."""
    gone = F.array(*[F.lit(p) for p in paths])
    left = claims.withColumn("paths", F.when(F.col("session") == session, F.array_except("paths", gone)).otherwise(F.col("paths")))
    return left.where(F.size("paths") > 0)
