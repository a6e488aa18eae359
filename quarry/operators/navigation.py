"""Navigation over an index of occurrences: definitions, references, hover, diagnostics, callers and callees.

``occ`` has a row an occurrence (file, ordinal, symbol, start_line, start_col, end_line, end_col, docs, diagnostics,
definition), ``known`` a row a symbol (symbol, docs), as ``sources.scip`` reads them.  Questions come in batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import storage
from quarry.functions import text as T

#: Names and files are told apart by so many buckets where places are looked at: what is sent to all tasks is as many numbers at most.
BUCKETS = 1 << 20


def short_name(symbol: Column) -> Column:
    """The last part of a symbol's descriptor, without the marks that end it."""
    plain = F.regexp_replace(symbol, r"[^\p{L}\p{N}_]+$", "")
    for mark in "/.#":  # a pattern for the last part tries every character of the others
        plain = F.substring_index(plain, mark, -1)
    return plain


def function_like(symbol: Column) -> Column:
    return F.contains(symbol, F.lit("()"))


def _first(occ: DataFrame, asked: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(query_id, name, symbol or null, marked): what the place of each question (query_id, name, file, line) says, or its file.

    A name's only symbol in a file is also what each of its places there says, so that questions meet a row a name and
    file.  Only those whose name has several symbols in the file meet places, and only of such names and files, found by
    a hash: a bounded set of buckets is sent to all tasks, whatever the number of questions.  Both steps are written, and
    their shuffles go.  ``marked`` (symbol) has the symbols that the last column marks.

    Here and below joins are merges: an index is small as files and large as rows, and the planner would send it whole.
    """
    given = None if marked is None else marked.select("symbol", F.lit(True).alias("marked")).distinct()
    mark = lambda rows: rows.withColumn("marked", F.lit(False)) if given is None else rows.hint("merge").join(given, "symbol", "left")
    named = occ.select(short_name(F.col("symbol")).alias("name"), "file", F.col("start_line").alias("line"), "ordinal", "symbol")
    sole = mark(named.select("name", "file", "symbol").distinct()).groupBy("name", "file")
    sole = sole.agg(F.min("symbol").alias("symbol"), F.max("marked").alias("marked"), (F.count("*") > 1).alias("several"))
    rows = asked.select("query_id", "name", "file", "line").hint("merge").join(sole, ["name", "file"], "left")
    several = F.coalesce("several", F.lit(False))
    place = [F.when(several, F.col(c)).alias(c) for c in ("file", "line")]
    rows = storage.written(rows.select("query_id", "name", *place, F.when(~several, F.col("symbol")).alias("symbol"), "marked", several.alias("several")), "questions", free=True)
    settled, rest = rows.where("not several"), rows.where("several").select("query_id", "name", "file", "line")
    if not rest.isEmpty():
        bucket = F.pmod(F.xxhash64("name", "file"), F.lit(BUCKETS)).alias("bucket")
        near = named.select("*", bucket).join(F.broadcast(rest.select(bucket).distinct()), "bucket", "left_semi")
        here = near.groupBy("name", "file", "line").agg(F.min_by("symbol", "ordinal").alias("symbol"))
        found = mark(rest.hint("merge").join(here, ["name", "file", "line"], "left")).select("query_id", "name", "symbol", "marked")
        settled = settled.select("query_id", "name", "symbol", "marked").unionAll(storage.written(found, "questions-of-places", free=True))
    return settled.select("query_id", "name", "symbol", F.coalesce("marked", F.lit(False)).alias("marked"))


def _with_ends(occ: DataFrame) -> DataFrame:
    """Definitions with the last line of their bodies: the line before the file's next one that has a definition."""
    after = Window.partitionBy("file").orderBy("start_line").rangeBetween(1, Window.unboundedFollowing)
    guess = F.min("start_line").over(after) - 1
    rows = occ.where("definition").withColumn("guess", guess)
    end = F.when(F.col("end_line") > F.coalesce("guess", "start_line"), F.col("end_line")).when(F.col("guess") > F.col("start_line"), F.col("guess"))
    return rows.withColumn("body_end", end)


def definitions(occ: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, symbol, file, line, end_line, score) of questions (query_id, name, file, line), one a row.

    The definitions of the symbol that the question's place or file says; if it has none, all of the name.  If neither
    says one, the definitions of the known symbols of that name, or, if these have none, all of the name.

    Definitions are put down by what may ask for them: a symbol, a name that no place decides, a name whose symbol is
    not defined.  Which of these a question asks for is known before it meets them, so that it is one row until the
    last join, whose rows, as many as all answers, are not shuffled again.
    """
    defs = _with_ends(occ).select("symbol", "file", F.col("start_line").alias("line"), F.col("body_end").alias("end_line"))
    defs = defs.withColumn("name", short_name(F.col("symbol")))
    defs = defs.hint("merge").join(known.select(F.col("symbol"), F.lit(True).alias("known")).distinct(), "symbol", "left")
    sure = F.max("known").over(Window.partitionBy("name"))
    key = lambda by, c, score: F.struct(F.lit(by).alias("by"), F.col(c).alias("key"), score.alias("score"))
    by = F.array(
        key("symbol", "symbol", F.lit(1.0)),
        F.when(F.col("known"), key("name", "name", F.lit(1.0))).when(F.col("sure").isNull(), key("name", "name", F.lit(0.9))),
        key("rest", "name", F.lit(0.9)),
    )
    table = defs.withColumn("sure", sure).select("symbol", "file", "line", "end_line", F.explode(by).alias("b"))
    table = table.where("b is not null").select("b.*", "symbol", "file", "line", "end_line")
    placed = F.col("symbol").isNotNull()
    asks = _first(occ, asked, occ.where("definition")).select(
        "query_id",
        F.when(~placed, "name").when(F.col("marked"), "symbol").otherwise("rest").alias("by"),
        F.when(placed & F.col("marked"), F.col("symbol")).otherwise(F.col("name")).alias("key"),
    )
    return asks.hint("merge").join(table, ["by", "key"]).select("query_id", "symbol", "file", "line", "end_line", "score")


def references(occ: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, symbol, file, line, kind, score) of questions (query_id, name, file, line), one a row.

    Every occurrence of the symbol that the question's place or file says, else of all known symbols of its name; by
    name, if none of these occurs.  What a name comes to is settled a symbol, so that occurrences meet questions once.
    """
    there = occ.select("symbol").distinct().withColumn("name", short_name(F.col("symbol")))
    there = there.hint("merge").join(known.select("symbol", F.lit(True).alias("known")).distinct(), "symbol", "left")
    sure = F.max("known").over(Window.partitionBy("name")).isNotNull()
    there = there.withColumn("sure", sure).where("known or not sure").select("name", "symbol", "sure")
    first = _first(occ, asked)
    wider = first.where("symbol is null").select("query_id", "name").hint("merge").join(there, "name").select("query_id", "symbol", "sure")
    asks = first.where("symbol is not null").select("query_id", "symbol", F.lit(True).alias("sure")).unionAll(wider)
    rows = occ.select("symbol", "file", F.col("start_line").alias("line"), "definition")
    hits = asks.hint("merge").join(rows, "symbol")
    own = F.col("sure") & F.col("definition")
    score = F.when(~F.col("sure"), 0.7).when(F.col("definition"), 1.0).otherwise(0.8)
    return hits.select("query_id", "symbol", "file", "line", F.when(own, "definition").otherwise("reference").alias("kind"), score.alias("score"))


def hover(occ: DataFrame, known: DataFrame, points: DataFrame) -> DataFrame:
    """(query_id, text) at points (query_id, file, line, col): of the first occurrence there, its own documentation, its symbol's, or the symbol."""
    lines = occ.select(
        "file", F.explode(F.sequence("start_line", "end_line")).alias("line"), "ordinal", "start_col", "end_col", "symbol", F.col("docs").alias("own")
    )
    at = points.join(lines, ["file", "line"]).where("col >= start_col and col < end_col")
    first = at.groupBy("query_id").agg(F.min_by(F.struct("symbol", "own"), "ordinal").alias("o")).select("query_id", "o.*")
    docs = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))
    return first.join(known, "symbol", "left").select("query_id", F.coalesce(docs("own"), docs("docs"), "symbol").alias("text"))


def diagnostics(occ: DataFrame) -> DataFrame:
    """(file, line, col, severity, code, message): a severity that is not known is a warning, an empty code none."""
    rows = occ.select("file", F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.explode("diagnostics").alias("d"))
    s = F.col("d.severity")
    level = F.when(s == 1, "error").when(s == 3, "info").when(s == 4, "hint").otherwise("warning")
    return rows.select("file", "line", "col", level.alias("severity"), F.nullif("d.code", F.lit("")).alias("code"), "d.message")


def _enclosed(occ: DataFrame, opens: Column) -> DataFrame:
    """Occurrences that define nothing, with the last definition (``within``, its ordinal ``at``) at or before their lines.

    One pass over a file in the order of lines, definitions first: a body ends where the next one begins.
    """
    last = Window.partitionBy("file").orderBy("start_line", F.col("definition").desc(), "ordinal")
    begun = F.last(F.when(opens, F.struct("symbol", "ordinal")), ignorenulls=True).over(last)
    return occ.withColumn("o", begun).where("not definition").select("*", F.col("o.symbol").alias("within"), F.col("o.ordinal").alias("at"))


def callees(occ: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, name, line, resolved_file) of questions (query_id, function, file): what the function's first definition holds."""
    inside = _enclosed(occ, F.col("definition")).withColumn("name", short_name(F.col("symbol")))
    first = occ.where("definition").select("file", short_name(F.col("symbol")).alias("function"), "start_line", "ordinal")
    first = first.groupBy("file", "function").agg(F.min_by("ordinal", F.struct("start_line", "ordinal")).alias("at"))
    language = F.regexp_extract("file", r"\.([A-Za-z]+)$", 1)
    uses = asked.hint("merge").join(first, ["file", "function"]).hint("merge").join(inside, ["file", "at"]).where("name <> function and name <> ''")
    uses = uses.where(~T.is_noise_callee(F.col("name"), language))
    uses = uses.groupBy("query_id", "name", F.col("start_line").alias("line")).agg(F.min_by("symbol", "ordinal").alias("symbol"))
    homes = occ.where("definition").groupBy("symbol").agg(F.min("file").alias("resolved_file"))
    return uses.hint("merge").join(homes, "symbol", "left").select("query_id", "name", "line", "resolved_file")


def callers(occ: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, file, function, line) of questions (query_id, name): functions that refer to a function of that name."""
    every = known.select("symbol").unionAll(occ.where("definition").select("symbol")).where(function_like(F.col("symbol"))).distinct()
    targets = asked.join(every.withColumn("name", short_name(F.col("symbol"))), "name")
    inside = _enclosed(occ, F.col("definition") & function_like(F.col("symbol"))).where("within is not null")
    inside = inside.select("symbol", "file", F.col("start_line").alias("line"), short_name(F.col("within")).alias("function"))
    return targets.join(inside, "symbol").where("function <> name").select("query_id", "file", "function", "line").distinct()
