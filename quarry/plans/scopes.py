"""Registered queries over the scopes of scripts; their SQL knows what the scripts were made from, not their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry import storage
from quarry.operators import scopes
from quarry.registry import register
from quarry.sources import scripts

_SC = f"sc AS ({A.SCRIPT_FACTS_SQL})"


def _structs(rows: list[tuple], keys: tuple[str, ...]) -> str:
    return ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in zip(keys, r, strict=True)) + "}" for r in rows)


def _names(spark, d):
    """The names of all scripts, walked once: declarations and uses are read from the table."""
    return storage.written(scripts.names(A.scripts(spark, d)), "script-names")


_OUTER, _RING, _MISSING = "concat('outer_', k)", "concat('Ring_', k)", "concat('missing_', k)"
_D, _R, _W = "'definition'", "'read'", "'write'"
# (name, kind, line, line of the declaration)
_REFERENCES = [
    ("'h'", _D, 1, 1), ("n", _D, 2, 2), ("'total'", _D, 3, 3), ("n", _R, 3, 2), (_OUTER, _D, 4, 4), ("n", _D, 4, 4), ("n", _R, 5, 4), ("'total'", _D, 5, 5),
    ("n", _R, 5, 4), ("'total'", _W, 5, 5), ("'total'", _W, 6, 3), ("'h'", _R, 6, 1), ("n", _R, 6, 4), ("'late'", _D, 6, 6), ("'x'", _D, 7, 7), ("'x'", _R, 7, 7),
    ("'late'", _R, 7, 6), (_RING, _D, 9, 9), ("n", _D, 9, 9), ("'y'", _D, 9, 9), ("'total'", _R, 9, 3), ("n", _R, 9, 9), ("'y'", _R, 9, 9), ("n", _R, 10, 2),
    (_OUTER, _R, 10, 4), ("'total'", _R, 10, 3),
]
# (name, how, line, exported, references, mutated)
_SYMBOLS = [
    ("'h'", "'import'", 1, "false", 1, "false"), ("n", "'const'", 2, "true", 2, "false"), ("'total'", "'let'", 3, "false", 3, "true"), (_OUTER, "'function'", 4, "false", 1, "false"),
    ("n", "'param'", 4, "false", 3, "false"), ("'total'", "'let'", 5, "false", 1, "true"), ("'late'", "'var'", 6, "false", 1, "false"), ("'x'", "'param'", 7, "false", 1, "false"),
    (_RING, "'class'", 9, "false", 0, "false"), ("n", "'param'", 9, "false", 1, "false"), ("'y'", "'param'", 9, "false", 1, "false"),
]


@register(
    "script_references",
    f"""WITH {_SC}, r AS (SELECT file_path, unnest([{_structs(_REFERENCES, ("name", "kind", "line", "declared"))}]) AS r FROM sc)
SELECT file_path, r.name AS name, r.kind AS kind, CAST(r.line AS BIGINT) AS line, CAST(r.declared AS BIGINT) AS declared_line FROM r""",
)
def script_references(spark, d):
    """All names of all scripts with the line of the declaration that they mean, past those that are shadowed."""
    rows = scopes.references(_names(spark, d))
    return rows.select("file_path", "name", "kind", F.col("line").cast("long").alias("line"), F.col("declared_line").cast("long").alias("declared_line"))


@register(
    "script_symbols",
    f"""WITH {_SC}, r AS (SELECT file_path, unnest([{_structs(_SYMBOLS, ("name", "how", "line", "exported", "n", "mutated"))}]) AS r FROM sc)
SELECT file_path, r.name AS name, r.how AS how, CAST(r.line AS BIGINT) AS line, r.exported AS exported, CAST(r.n AS BIGINT) AS reference_count, r.mutated AS mutated FROM r""",
)
def script_symbols(spark, d):
    rows = scopes.symbols(_names(spark, d))
    return rows.select("file_path", "name", "how", F.col("line").cast("long").alias("line"), "exported", "reference_count", "mutated")


@register(
    "script_unresolved",
    f"""WITH {_SC}, r AS (SELECT file_path, unnest([{_structs([(_MISSING, 7), ("'console'", 10)], ("name", "line"))}]) AS r FROM sc)
SELECT file_path, r.name AS name, CAST(1 AS BIGINT) AS uses, CAST(r.line AS BIGINT) AS first_line FROM r""",
)
def script_unresolved(spark, d):
    rows = scopes.unresolved(_names(spark, d))
    return rows.select("file_path", "name", "uses", F.col("first_line").cast("long").alias("first_line"))
