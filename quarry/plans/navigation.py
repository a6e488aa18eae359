"""Registered queries over an index of occurrences that is written as files and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry import storage
from quarry.operators import navigation
from quarry.registry import register
from quarry.sources import scip

# Definitions are at column 0 of their lines; calls refer, at column 4, to the first symbol of their name.
_INDEX = f"""code AS ({A.CODE_SQL}), edges AS ({A.EDGES_SQL}), calls AS ({A.CODE_CALLS_SQL}),
s AS (SELECT DISTINCT name, file_path AS file, line, concat('q q q 1 ', file_path, '/', name, CASE kind WHEN 'class' THEN '#' ELSE '().' END) AS symbol FROM code),
t AS (SELECT name, min(symbol) AS symbol FROM s GROUP BY 1),
o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, col, symbol) AS ordinal FROM (
  SELECT file, line, 0 AS col, CASE WHEN line % 7 = 0 THEN line + 2 ELSE line END AS end_line, name, symbol, true AS def FROM s
  UNION SELECT caller_file, call_id % 60, 4, call_id % 60, callee_name, t.symbol, false FROM calls JOIN t ON t.name = callee_name))"""
_ASKED = """asked AS (SELECT concat(file, ':', line, ':', name) AS query_id, name, CASE WHEN line % 3 = 2 THEN 'elsewhere' ELSE file END AS file,
  CASE WHEN line % 3 = 1 THEN line + 1000 ELSE line END AS line FROM (SELECT DISTINCT name, file, line FROM o WHERE NOT def)),
here AS (SELECT query_id, min_by(symbol, ordinal) AS symbol FROM asked JOIN o USING (name, file, line) GROUP BY 1),
one AS (SELECT query_id, min(symbol) AS sole FROM asked JOIN o USING (name, file) GROUP BY 1 HAVING count(DISTINCT symbol) = 1),
fst AS (SELECT query_id, name, coalesce(symbol, sole) AS symbol FROM asked LEFT JOIN here USING (query_id) LEFT JOIN one USING (query_id)),
target AS (SELECT query_id, symbol FROM fst WHERE symbol IS NOT NULL UNION ALL
  SELECT query_id, k.symbol FROM fst JOIN (SELECT DISTINCT name, symbol FROM s) k USING (name) WHERE fst.symbol IS NULL)"""

_FOLDERS: dict[tuple[str, str], str] = {}


def _occurrences(spark, d):
    """(file, line, name, symbol, roles) of all definitions and uses, once each and by file, and the symbols."""
    c = A.code(spark, d)
    mark = F.when(F.col("kind") == "class", "#").otherwise("().")
    s = c.select("name", F.col("file_path").alias("file"), "line", F.concat(F.lit("q q q 1 "), "file_path", F.lit("/"), "name", mark).alias("symbol")).distinct()
    t = s.groupBy("name").agg(F.min("symbol").alias("symbol"))
    refs = A.code_calls(A.edges(spark, d), c).join(t, F.col("callee_name") == t["name"])
    refs = refs.select(F.col("caller_file").alias("file"), (F.col("call_id") % 60).alias("line"), "name", "symbol", F.lit(0).alias("roles"))
    # a file is one document in the end, so that its rows are shuffled once, and made distinct where they meet
    return s.select("file", "line", "name", "symbol", F.lit(1).alias("roles")).unionAll(refs).repartition("file").distinct(), s


def _folder(spark, d):
    """The folder of the index files of a directory's code; written once a session, and read by all queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        occ, s = _occurrences(spark, d)
        line, defines = F.col("line"), F.col("roles") == 1
        col, end = F.when(defines, 0).otherwise(4), F.when(defines & (line % 7 == 0), line + 2).otherwise(line)
        found = F.struct(
            F.concat(F.lit("E"), line).alias("code"), F.concat(F.lit("look at "), "name").alias("message"), (line % 5).cast("int").alias("severity")
        )
        found = F.when(defines & (line % 4 == 0), F.array(found.cast("struct<code:string,message:string,severity:int>")))
        row = F.struct(
            line.cast("int").alias("start_line"), col.alias("start_col"), "symbol", end.cast("int").alias("end_line"),
            (col + F.length("name")).alias("end_col"), "roles",
            F.when((line % 6 == 0) & ~defines, F.array(F.concat(F.lit("call of "), "name"))).otherwise(F.array().cast("array<string>")).alias("docs"),
            F.coalesce(found, F.array().cast("array<struct<code:string,message:string,severity:int>>")).alias("diagnostics"),
        )
        docs = F.when(line % 2 == 0, F.array(F.concat(F.lit("about "), "name"), F.lit("more"))).otherwise(F.array().cast("array<string>"))
        known = s.groupBy("file").agg(F.collect_list(F.struct("symbol", docs.alias("docs"), F.col("name").alias("display_name"))).alias("symbols"))
        rows = occ.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list(row)).alias("occurrences"))
        rows = rows.join(known.withColumnRenamed("file", "path"), "path", "left").withColumn("language", F.regexp_extract("path", r"\.([a-z]+)$", 1))
        folder = storage.new_folder(spark, "index-files")
        with storage.freed(spark):
            scip.write(rows, folder)
        _FOLDERS[key] = folder
    return _FOLDERS[key]


def _read(spark, d):
    docs = storage.written(scip.read(spark, _folder(spark, d)), "index-documents", free=True)  # each question reads it several times
    return scip.occurrences(docs), scip.symbols(docs)


def _asked(occ):
    """Each use is a question: the index has it once, and a name's uses have one symbol."""
    name = navigation.short_name(F.col("symbol"))
    rows = occ.where("not definition").select(name.alias("name"), "file", F.col("start_line").alias("line"))
    kind = F.col("line") % 3
    return rows.select(
        F.concat_ws(":", "file", "line", "name").alias("query_id"), "name",
        F.when(kind == 2, "elsewhere").otherwise(F.col("file")).alias("file"), F.when(kind == 1, F.col("line") + 1000).otherwise(F.col("line")).alias("line"),
    )


@register(
    "scip_definitions",
    f"""WITH {_INDEX}, {_ASKED}, nx AS (SELECT file, line, lead(line) OVER (PARTITION BY file ORDER BY line) - 1 AS guess FROM (SELECT DISTINCT file, line FROM o WHERE def))
SELECT query_id, symbol, o.file, CAST(o.line AS INTEGER) AS line, CAST(CASE WHEN guess IS NULL THEN nullif(end_line, o.line) WHEN end_line > guess THEN nullif(end_line, o.line)
  WHEN guess > o.line THEN guess END AS INTEGER) AS end_line, 1.0::DOUBLE AS score FROM target JOIN o USING (symbol) JOIN nx ON nx.file = o.file AND nx.line = o.line WHERE def""",
)
def scip_definitions(spark, d):
    occ, known = _read(spark, d)
    return navigation.definitions(occ, known, _asked(occ))


@register(
    "scip_references",
    f"""WITH {_INDEX} SELECT s.name AS query_id, o.symbol, o.file, CAST(o.line AS INTEGER) AS line, CASE WHEN def THEN 'definition' ELSE 'reference' END AS kind,
  CASE WHEN def THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM (SELECT DISTINCT name, symbol FROM s) s JOIN o USING (symbol)""",
)
def scip_references(spark, d):
    occ, known = _read(spark, d)
    name = navigation.short_name(F.col("symbol"))
    asked = occ.select(name.alias("query_id"), name.alias("name"), F.lit("").alias("file"), F.lit(0).alias("line")).distinct()
    return navigation.references(occ, known, asked)


@register(
    "scip_hover",
    f"""WITH {_INDEX}, p AS (SELECT DISTINCT file, line FROM o WHERE NOT def), f AS (SELECT p.file, p.line, min_by(row(o.symbol, o.name, o.def, o.line), ordinal) AS x
  FROM p JOIN o ON o.file = p.file AND p.line BETWEEN o.line AND o.end_line WHERE 6 >= col AND 6 < col + length(name) GROUP BY 1, 2),
g AS (SELECT file, line, x[1] AS symbol, x[2] AS name, x[3] AS def, x[4] AS ln FROM f), k AS (SELECT symbol, min(line) AS dl FROM s GROUP BY 1)
SELECT concat(file, ':', line) AS query_id, CASE WHEN NOT def AND ln % 6 = 0 THEN concat('call of ', name) WHEN dl % 2 = 0 THEN concat('about ', name, chr(10), 'more') ELSE symbol END AS text
FROM g JOIN k USING (symbol)""",
)
def scip_hover(spark, d):
    occ, known = _read(spark, d)
    points = occ.where("not definition").select("file", F.col("start_line").alias("line")).distinct()
    return navigation.hover(occ, known, points.select(F.concat_ws(":", "file", "line").alias("query_id"), "file", "line", F.lit(6).alias("col")))


@register(
    "scip_diagnostics",
    f"""WITH {_INDEX} SELECT file, CAST(line AS INTEGER) AS line, 0 AS col, CASE line % 5 WHEN 1 THEN 'error' WHEN 3 THEN 'info' WHEN 4 THEN 'hint' ELSE 'warning' END AS severity,
  concat('E', line) AS code, concat('look at ', name) AS message FROM o WHERE def AND line % 4 = 0""",
)
def scip_diagnostics(spark, d):
    return navigation.diagnostics(scip.occurrences(scip.read(spark, _folder(spark, d))))  # read once, so not written


_BEGUN = "last_value(CASE WHEN {0} THEN row(name, ordinal) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line, def DESC, ordinal ROWS UNBOUNDED PRECEDING)"


@register(
    "scip_callees",
    f"""WITH {_INDEX}, i AS (SELECT *, {_BEGUN.format("def")} AS w FROM o), u AS (SELECT file, w[1] AS fn, name, line, min_by(symbol, ordinal) AS symbol FROM i WHERE NOT def AND w IS NOT NULL AND name <> w[1] GROUP BY 1, 2, 3, 4)
SELECT concat(u.file, ':', fn) AS query_id, u.name, CAST(u.line AS INTEGER) AS line, s.file AS resolved_file FROM u JOIN (SELECT symbol, min(file) AS file FROM s GROUP BY 1) s USING (symbol)""",
)
def scip_callees(spark, d):
    occ, _ = _read(spark, d)
    asked = occ.where("definition").select("file", navigation.short_name(F.col("symbol")).alias("function")).distinct()
    return navigation.callees(occ, asked.withColumn("query_id", F.concat_ws(":", "file", "function")))


@register(
    "scip_callers",
    f"""WITH {_INDEX}, i AS (SELECT *, {_BEGUN.format("def AND contains(symbol, '()')")} AS w FROM o)
SELECT DISTINCT name AS query_id, file, w[1] AS function, CAST(line AS INTEGER) AS line FROM i WHERE NOT def AND w IS NOT NULL AND contains(symbol, '()') AND w[1] <> name""",
)
def scip_callers(spark, d):
    occ, known = _read(spark, d)
    name = navigation.short_name(F.col("symbol"))
    return navigation.callers(occ, known, occ.where(navigation.function_like(F.col("symbol"))).select(name.alias("query_id"), name.alias("name")).distinct())
