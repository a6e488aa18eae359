"""What version control prints, as rows: name-status listings, porcelain states, and commit logs with their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lookup import first_wins


def name_status(lines: DataFrame) -> DataFrame:
    """(file, status) from lines (line) like M<tab>path and R100<tab>old<tab>new: the letter, and the newer path."""
    parts = F.split("line", "\t")
    rows = lines.where(F.contains("line", F.lit("\t"))).select(F.element_at(parts, -1).alias("file"), F.substring(F.trim(parts[0]), 1, 1).alias("status"))
    return rows.where("file <> '' AND status <> ''")


def porcelain(lines: DataFrame) -> DataFrame:
    """(file, status) from short status lines (line): two letters, a blank and a path; renames have their newer path."""
    state = F.trim(F.substring("line", 1, 2))
    path = F.element_at(F.split(F.substring(F.col("line"), F.lit(4), F.length("line")), " -> "), -1)
    return lines.where(F.length("line") > 3).select(F.trim(path, F.lit('"')).alias("file"), F.substring(state, 1, 1).alias("status"))


def changed(listings: list[DataFrame]) -> DataFrame:
    """(file, status) of several listings: the first that has a file decides."""
    rows = reduce(DataFrame.unionAll, [df.select("file", "status", F.lit(i).alias("p")) for i, df in enumerate(listings)])
    return first_wins(rows.groupBy("file", "p").agg(F.min("status").alias("status")), "file", "p").select("file", "status")


def commit_log(texts: DataFrame) -> DataFrame:
    """(commit_id, author, at, file) from logs (text): a line commit<tab>id<tab>author<tab>time, then a file a line, then a blank one."""
    blocks = texts.select(F.explode(F.split("text", r"(?m)^(?=commit\t)")).alias("block")).where(F.col("block").startswith("commit\t"))
    lines = F.split("block", "\n")
    head = F.split(lines[0], "\t")
    files = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")
    return blocks.select(head[1].alias("commit_id"), head[2].alias("author"), F.try_to_number(head[3], F.lit("9999999999999")).cast("long").alias("at"), F.explode(files).alias("file"))
