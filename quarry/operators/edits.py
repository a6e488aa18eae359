"""Dry-run edit plans: what a refactoring would change, as rows; files are never touched."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.arrays import running
from quarry.operators.lookup import code_lines, lines


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """(id, line_no, before, after) of each line with the identifier; strings and comments stay as they are."""
    word = rf"\b{re.escape(old)}\b"
    rows = code_lines(files.where(F.col("content").rlike(word))).where(F.col("code").rlike(word))

    def pieces(x: Column) -> Column:
        """What lies between the places, from the line itself."""
        starts = running(F.transform(x, lambda p: F.length(p) + len(old)), "int", F.lit(0), lambda at, n: at + n)
        return F.transform(F.arrays_zip(x.alias("p"), starts.alias("at")), lambda z: F.substring(F.col("line"), z["at"] + 1, F.length(z["p"])))

    after = F.array_join(T.let(F.split("code", word, -1), pieces), new)
    return rows.select("id", "line_no", F.col("line").alias("before"), after.alias("after"))


def replace_lines(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, stop, after): line ranges (id, start, stop, body) that would be replaced, clamped to the file."""
    n = F.size(F.split("content", "\n")).cast("long")
    return files.join(spans, "id").select(
        "id", F.greatest(F.col("start"), F.lit(1)).alias("start"), F.least(F.col("stop"), n).alias("stop"), F.col("body").alias("after")
    )


def insert(symbols: DataFrame, name: str, body: str, before: bool) -> DataFrame:
    """(id, file_path, line, after): where text would go next to each symbol of a name."""
    line = F.col("line") if before else F.col("line") + 1
    return symbols.where(F.col("name") == name).select("id", "file_path", line.alias("line"), F.lit(body).alias("after"))


def move(symbols: DataFrame, importers: DataFrame, name: str, target: str) -> DataFrame:
    """(file_path, action): the file that loses a symbol, the one that gets it, and those whose imports change."""
    here = symbols.where(F.col("name") == name).select("file_path").distinct()
    users = importers.join(here.withColumnRenamed("file_path", "dst"), "dst").select(F.col("src").alias("file_path")).distinct()
    return (
        here.withColumn("action", F.lit("remove"))
        .unionAll(here.sparkSession.createDataFrame([(target, "insert")], "file_path string, action string"))
        .unionAll(users.withColumn("action", F.lit("update_import")))
    )


def safe_delete(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(name, callers, importers, safe): a name may go if nothing calls it and no other file imports one of its files."""
    n = calls.groupBy(F.col("callee_name").alias("name")).agg(F.countDistinct("caller_name").alias("n"))
    files = symbols.select("name", F.col("file_path").alias("dst")).distinct()
    # a name of one file has that file's importers, which are counted once a file; only names of several files meet them
    single = files.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).where("n = 1")
    links = imports.where("src <> dst").select("src", "dst").distinct()
    one = single.join(links.groupBy("dst").agg(F.count(F.lit(1)).alias("m")), "dst").select("name", "m")
    more = files.join(single.select("name"), "name", "left_anti").join(links, "dst").select("name", "src").distinct()
    users = one.unionByName(more.groupBy("name").agg(F.count(F.lit(1)).alias("m")))
    callers, importers = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n", "m"))
    rows = symbols.select("name").distinct().join(n, "name", "left").join(users, "name", "left")
    return rows.select("name", callers.alias("callers"), importers.alias("importers"), (callers + importers == 0).alias("safe"))


# How a function without parameters is written and called, by file type.
SHAPES = {
    "py": ("def {0}():\n{1}\n", "{2}{0}()"),
    "js": ("function {0}() {{\n{1}\n}}\n", "{2}{0}();"),
    "rs": ("fn {0}() {{\n{1}\n}}\n", "{2}{0}();"),
    "go": ("func {0}() {{\n{1}\n}}\n", "{2}{0}()"),
}


def _filled(shape: str, *values: Column) -> Column:
    parts = re.split(r"(\{\d\})", shape)
    text = lambda x: F.lit(x.replace("{{", "{").replace("}}", "}"))
    return F.concat(*[values[int(x[1])] if re.fullmatch(r"\{\d\}", x) else text(x) for x in parts if x])


def extract(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, valid, definition, call): lines (id, start, stop, name) as a function of their own, and what stands for them.

    Ranges that the file does not have, and file types without a shape, are not valid and have neither.
    """
    rows = files.join(spans, "id").withColumn("rows", F.split("content", "\n"))
    ext = T.extension(F.col("relative_path"))
    ext = F.when(ext.isin("jsx", "ts", "tsx", "mjs", "cjs"), "js").otherwise(ext)
    ok = (F.col("start") >= 1) & (F.col("stop") >= F.col("start")) & (F.col("stop") <= F.size("rows")) & ext.isin(*SHAPES)
    taken = F.slice("rows", F.greatest(F.col("start"), F.lit(1)).cast("int"), F.greatest(F.col("stop") - F.col("start") + 1, F.lit(0)).cast("int"))
    rows = rows.withColumn("ext", ext).withColumn("valid", ok).withColumn("taken", taken)
    rows = rows.withColumn("indent", F.regexp_extract(F.coalesce(F.get("taken", 0), F.lit("")), r"^\s*", 0))
    cut = F.transform(
        "taken",
        lambda x: F.concat(
            F.lit("    "),
            F.when(x.startswith(F.col("indent")) & (F.length(x) > F.length("indent")), F.substring(x, F.length("indent") + 1, F.length(x))).otherwise(F.trim(x)),
        ),
    )
    values = (F.col("name"), F.array_join(cut, "\n"), F.col("indent"))
    shape = lambda i: reduce(lambda acc, kv: acc.when(F.col("ext") == kv[0], _filled(kv[1][i], *values)), SHAPES.items(), F)
    return rows.select("id", "valid", F.when(F.col("valid"), shape(0)).alias("definition"), F.when(F.col("valid"), shape(1)).alias("call"))


def inline(files: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(id, line_no, action, after): one-line functions (id, line_no, name, target) taken out, and their calls by what they forward to.

    Calls are inlined within the file of the definition; arguments stay as they are.
    """
    # both sides grow with the files, whatever their inputs' sizes let a planner guess: neither is sent to every task
    rows = lines(files).hint("merge").join(wrappers.select("id", F.col("line_no").alias("at"), "name", "target"), "id")
    word = F.concat(F.lit(r"\b"), "name", F.lit(r"\("))
    gone = rows.where(F.col("line_no") == F.col("at")).select("id", "line_no", F.lit("remove").alias("action"), F.lit("").alias("after"))
    used = rows.where((F.col("line_no") != F.col("at")) & F.regexp_like("line", word))
    after = F.regexp_replace("line", word, F.concat("target", F.lit("(")))
    return gone.unionAll(used.select("id", "line_no", F.lit("replace").alias("action"), after.alias("after")))


def change_signature(files: DataFrame, name: str, parameters: str) -> DataFrame:
    """(id, line_no, action, after): definitions with new parameters, and the calls that have to be looked at."""
    word = re.escape(name)
    define = rf"\b(?:fn|def|function|func)\s+{word}\s*\([^)]*\)"
    rows = lines(files.where(F.col("content").rlike(rf"\b{word}\s*\("))).where(F.col("line").rlike(rf"\b{word}\s*\("))
    new = parameters.replace("\\", "\\\\").replace("$", "\\$")
    after = F.regexp_replace("line", rf"(\b(?:fn|def|function|func)\s+{word}\s*)\([^)]*\)", f"$1({new})")
    own = F.col("line").rlike(define)
    return rows.select("id", "line_no", F.when(own, "replace").otherwise("review").alias("action"), F.when(own, after).otherwise(F.col("line")).alias("after"))
