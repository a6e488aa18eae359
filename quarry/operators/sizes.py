"""Checked sizes: what is broadcast has been counted, up to a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a query batch, or of another small side, that are sent to every task.
LIMIT = 10_000


def batch(queries: DataFrame, limit: int | None = None) -> DataFrame:
    """A batch of queries to broadcast; a larger one has to be split by its caller."""
    limit = LIMIT if limit is None else limit
    if queries.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} queries in a batch")
    return F.broadcast(queries)


def small(side: DataFrame) -> DataFrame:
    """One side of an equi-join: broadcast if it has few rows, else left to the planner, which shuffles."""
    return F.broadcast(side) if side.limit(LIMIT + 1).count() <= LIMIT else side
