"""Sources and sinks: a project's files, symbols and calls in their languages, JSON lines, partitioned model tables."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import syntax
from quarry.functions import text as T
from quarry.sources import buckets
from quarry.storage import written

# What a walk leaves out: folders by name and by start, files by name and by end.
EXCLUDED = (
    ".git", ".idea", ".vscode", ".cursor", ".claude", ".claire", ".serena", ".superpowers",
    ".gradle", "build", "dist", "generated", "out", "node_modules", "vendor", "__pycache__", "target", ".next", "win-unpacked",
    ".venv", "venv", ".tox", "env",
    ".cache", ".ruff_cache", ".pytest_cache", ".mypy_cache", ".fastembed_cache",
    ".antigravity", ".windsurf", "Library", ".worktrees",
)
EXCLUDED_STARTS = ("backup-", ".venv")
EXCLUDED_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb", "LICENSES.chromium.html")
EXCLUDED_ENDS = (".min.js", ".bundle.js", ".bundle.iife.js", "-bundle.js", ".gen.ts", ".gen.tsx", ".generated.ts", ".generated.tsx")


def excluded(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a walk leaves out a path below the root; ``more`` has glob patterns of the project's own."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    folder = lambda p: reduce(lambda a, x: a | p.startswith(x), EXCLUDED_STARTS, p.isin(*EXCLUDED))
    out = F.exists(parts, folder) | name.isin(*EXCLUDED_FILES)
    out = reduce(lambda a, x: a | name.endswith(x), EXCLUDED_ENDS, out)
    return reduce(lambda a, x: a | path.rlike(T.glob_regex(x)), more, out)


def project_files(spark: SparkSession, root: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(relative_path, content, size_bytes, mtime_ms, content_hash): a recursive listing without what is excluded.

    Listing and reading are Spark's: any storage it can read will do.  Files of any size are read; only what lies
    below the root decides, and excluded files are left out by path, before their content is looked at.
    """
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .withColumn("relative_path", rel)
        .where(~excluded(F.col("relative_path"), more))
        .select(
            "relative_path",
            F.decode("content", "UTF-8").alias("content"),
            F.col("length").alias("size_bytes"),
            F.unix_millis("modificationTime").alias("mtime_ms"),
        )
        .withColumn("content_hash", F.sha2("content", 256))
    )


#: What a parser raises for texts that it cannot take; RecursionError and MemoryError for nesting beyond its own depth.
_FAILS = (SyntaxError, ValueError, RecursionError, MemoryError)


def _python_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except _FAILS as e:
        yield path, "error", type(e).__name__, "", "", 0, 0, str(e)[:200]
        return
    rows = text.splitlines()
    todo = [(tree, "", False, False)]  # node, owner, whether the owner is a class, whether the node itself is a row
    while todo:
        node, owner, in_class, own = todo.pop()
        if own:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                name_path = f"{owner}/{node.name}" if owner else node.name
                yield path, "symbol", node.name, kind, name_path, node.lineno, node.end_lineno, rows[node.lineno - 1].strip()[:200]
                owner, in_class = name_path, is_class
            else:
                if isinstance(node, ast.Call):
                    f = node.func
                    callee = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if callee:
                        yield path, "call", callee, "", owner or "<module>", node.lineno, node.lineno, ""
                elif isinstance(node, ast.Import):
                    for a in node.names:
                        yield path, "import", a.name, "", owner, node.lineno, node.lineno, ""
                elif isinstance(node, ast.ImportFrom):
                    yield path, "import", "." * node.level + (node.module or ""), "", owner, node.lineno, node.lineno, ""
                in_class = in_class and not isinstance(node, ast.expr)
        todo += [(child, owner, in_class, True) for child in reversed(list(ast.iter_child_nodes(node)))]


_COLUMNS = ["file_path", "row", "name", "kind", "name_path", "line", "end_line", "signature"]


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [r for p, t in zip(frame["relative_path"], frame["content"], strict=True) for r in _python_rows(p, t or "")]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def parse_python(files: DataFrame) -> DataFrame:
    """Symbols, calls and imports of Python files, one Arrow pass; files that do not parse give an error row.

    For calls ``name_path`` is the enclosing definition, ``<module>`` outside one.
    """
    return files.select("relative_path", "content").mapInPandas(
        _parse, "file_path string, row string, name string, kind string, name_path string, line long, end_line long, signature string"
    )


def parse_sources(files: DataFrame) -> DataFrame:
    """Symbols and calls, as ``parse_python`` has them, of files in languages with braces, by their type; no imports."""
    rows = files.select(
        F.col("relative_path").alias("file_path"),
        F.split(F.coalesce("content", F.lit("")), "\n").alias("rows"),
        F.explode(syntax.parsed(F.col("content"), T.extension(F.col("relative_path")))).alias("r"),
    )
    signature = F.when(F.col("r.row") == "symbol", F.substring(F.trim(F.get("rows", F.col("r.line") - 1)), 1, 200)).otherwise("")
    return rows.select("file_path", "r.row", "r.name", "r.kind", "r.name_path", F.col("r.line").cast("long").alias("line"), F.col("r.end_line").cast("long").alias("end_line"), signature.alias("signature"))


def refresh(spark: SparkSession, root: str, folder: str, version: int) -> dict[str, int]:
    """Brings an index of a project up to date: files by content hash, and the symbols, calls and imports of changed ones.

    Files that are as they were are not parsed; rows of changed and of vanished files go with them.
    """
    now = project_files(spark, root).select("relative_path", "content", "content_hash", "size_bytes", "mtime_ms")
    old = buckets.latest(spark, f"{folder}/files")
    known = old if old is not None else now.limit(0)
    changed = written(now.join(known.select("relative_path", "content_hash"), ["relative_path", "content_hash"], "left_anti"), "refresh-changed")
    gone = written(known.select("relative_path").join(now.select("relative_path"), "relative_path", "left_anti"), "refresh-gone")
    no, yes = F.lit(False).alias("deleted"), F.lit(True).alias("deleted")
    files = changed.drop("content").select("*", no).unionByName(gone.select("relative_path", yes), allowMissingColumns=True)
    buckets.merge(files, f"{folder}/files", "relative_path", version)
    python = F.col("relative_path").endswith(".py")
    rows = parse_python(changed.where(python)).unionByName(parse_sources(changed.where(~python))).select("*", no)
    marks = changed.select("relative_path").unionAll(gone).select(F.col("relative_path").alias("file_path"), yes)
    buckets.merge(rows.unionByName(marks, allowMissingColumns=True), f"{folder}/rows", "file_path", version)
    return {"changed": changed.count(), "gone": gone.count()}


def write_jsonl(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(folder)


def read_jsonl(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def federated(projects: dict[str, DataFrame]) -> DataFrame:
    """Rows of several projects with a project column."""
    out = None
    for name, df in projects.items():
        df = df.withColumn("project", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def _reference_rows(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except _FAILS:
        return
    todo = [(tree, "", False)]
    while todo:
        node, scope, own = todo.pop()
        if own:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield path, node.name, node.lineno, "definition", scope
                scope = f"{scope}/{node.name}" if scope else node.name
            elif isinstance(node, ast.Name):
                yield path, node.id, node.lineno, "read" if isinstance(node.ctx, ast.Load) else "write", scope
            elif isinstance(node, ast.arg):
                yield path, node.arg, node.lineno, "definition", scope
            elif isinstance(node, ast.alias):
                yield path, (node.asname or node.name).split(".")[0], node.lineno, "import", scope
        todo += [(child, scope, True) for child in reversed(list(ast.iter_child_nodes(node)))]


def _references(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [r for p, t in zip(frame["relative_path"], frame["content"], strict=True) for r in _reference_rows(p, t or "")]
        yield pd.DataFrame(rows, columns=["file_path", "name", "line", "kind", "scope"])


def scoped_references(files: DataFrame) -> DataFrame:
    """(file_path, name, line, kind, scope) in Python files: definitions, reads, writes and imports."""
    return files.select("relative_path", "content").mapInPandas(
        _references, "file_path string, name string, line long, kind string, scope string"
    )
