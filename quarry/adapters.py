"""Views that project the driver's tables onto the code-index model.

Each adapter is a list of expressions in the common subset of Spark SQL and DuckDB, so that operator and
oracle read the same rows; the operators on top are written independently of their SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts in files for all cores: a part is a few bytes that become texts of many, and one file of them is one task.

    They are written, as filters on the texts would be pushed down through an exchange, back into that task.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return storage.written(table(spark, sf_dir, "part").repartition(parts, "p_partkey"), "parts")


_SYMBOLS = [
    "CAST(p_partkey AS BIGINT) AS id",
    "replace(p_name, ' ', '_') AS name",
    "CASE p_type WHEN 'ECONOMY' THEN 'function' WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'class' "
    "WHEN 'LARGE' THEN 'interface' WHEN 'SMALL' THEN 'variable' ELSE 'enum' END AS kind",
    "concat('src/', lower(replace(p_brand, '#', '')), '/', lower(p_type), '.rs') AS file_path",
    "CAST(p_size AS BIGINT) AS line",
    "concat('fn ', replace(p_name, ' ', '_'), '(', lower(p_type), ')') AS signature",
    "concat(p_brand, '/', replace(p_name, ' ', '_')) AS name_path",
]
SYMBOLS_SQL = f"SELECT {', '.join(_SYMBOLS)} FROM part"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per part: 64 names over a directory per brand and a file per type."""
    return table(spark, sf_dir, "part").selectExpr(*_SYMBOLS)


_FILES = [
    "CAST(doc_id AS BIGINT) AS id",
    "concat(source, '/', CAST(doc_id AS STRING), '.', lang) AS relative_path",
    "CAST(n_chars AS BIGINT) AS size_bytes",
    "lang AS language",
    "text AS content",
]
FILES_SQL = f"SELECT {', '.join(_FILES)} FROM documents".replace("AS STRING", "AS VARCHAR")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document."""
    return table(spark, sf_dir, "documents").selectExpr(*_FILES)


COMMITS_SQL = (
    "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS commit_id, concat('s', CAST(l_suppkey AS VARCHAR)) AS file "
    "FROM lineitem"
)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit per order, its files the suppliers."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr("CAST(l_orderkey AS BIGINT) AS commit_id", "concat('s', CAST(l_suppkey AS STRING)) AS file")
        .distinct()
    )


EDGES_SQL = """SELECT DISTINCT src, dst FROM (
  SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS src, l_partkey AS dst
  FROM lineitem) WHERE src IS NOT NULL AND src <> dst"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports (src, dst): from the part of the line before to the part of a line, in all orders."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")  # an order's lines
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.lag("l_partkey").over(by).alias("src"), F.col("l_partkey").alias("dst"))
        .where("src IS NOT NULL AND src <> dst")
        .distinct()
    )


PACKAGE_EDGES_SQL = f"SELECT src, dst FROM ({EDGES_SQL}) JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand = b.p_brand"


def package_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports that stay within a package, the brand: a sparse graph of many components."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("pa"))
    b = p.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("pb"))
    return edges(spark, sf_dir).join(a, "src").join(b, "dst").where("pa = pb").select("src", "dst")


# Code: a file per brand, size class and type, in four languages; imports go from a part's file to the next part's.
_CODE = [
    "CAST(p_partkey AS BIGINT) AS id",
    "concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)) AS name",
    "CASE p_type WHEN 'MEDIUM' THEN 'method' WHEN 'PROMO' THEN 'class' ELSE 'function' END AS kind",
    "concat('src/', lower(replace(p_brand, '#', '')), '/s', CAST(p_size % 10 AS STRING), '/', lower(p_type), "
    "CASE p_type WHEN 'ECONOMY' THEN '.rs' WHEN 'MEDIUM' THEN '.rs' WHEN 'PROMO' THEN '.ts' WHEN 'LARGE' THEN '.ts' "
    "WHEN 'SMALL' THEN '.py' ELSE '.go' END) AS file_path",
    "concat(p_brand, '/', replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)) AS name_path",
    "CAST(p_size AS BIGINT) AS line",
    "p_brand AS brand",
    "lower(p_type) AS type",
]
CODE_SQL = f"SELECT {', '.join(_CODE)} FROM part".replace("AS STRING", "AS VARCHAR")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, file_path, name_path, line, brand, type): the symbols of the call graph."""
    return table(spark, sf_dir, "part").selectExpr(*_CODE)


CODE_IMPORTS_SQL = (
    "SELECT DISTINCT a.file_path AS src, CASE WHEN b.id % 6 = 0 THEN replace(b.file_path, 'src/', '') ELSE b.file_path END AS dst "
    "FROM code a JOIN code b ON b.id = a.id + 1"
)


def _neighbours(c: DataFrame) -> DataFrame:
    a = c.select(F.col("id").alias("aid"), F.col("file_path").alias("src"))
    return a.join(c.withColumn("aid", F.col("id") - 1), "aid")


def code_imports(c: DataFrame) -> DataFrame:
    """(src, dst): files; some imports name their target without its first folder."""
    short = F.when(F.col("id") % 6 == 0, F.replace("file_path", F.lit("src/"), F.lit(""))).otherwise(F.col("file_path"))
    return _neighbours(c).select("src", short.alias("dst")).distinct()


BINDINGS_SQL = """SELECT file, local, imported, target, external FROM (
  SELECT a.file_path AS file, CASE WHEN b.id % 5 < 2 OR b.id % 5 = 4 THEN b.name WHEN b.id % 5 = 2 THEN concat('ns_', b.type) ELSE '*' END AS local,
    CASE WHEN b.id % 5 < 2 THEN b.name WHEN b.id % 5 = 4 THEN 'x' ELSE '*' END AS imported, CASE WHEN b.id % 5 < 4 THEN b.file_path END AS target,
    b.id % 5 = 4 AS external, b.id AS o
  FROM code a JOIN code b ON b.id = a.id + 1 WHERE ends_with(a.file_path, '.ts'))
  QUALIFY row_number() OVER (PARTITION BY file, local ORDER BY o) = 1"""


def bindings(c: DataFrame) -> DataFrame:
    """What the clauses of the TypeScript files bind: names, whole modules, everything handed on, foreign names."""
    kind = F.col("id") % 5
    rows = _neighbours(c).where(F.col("src").endswith(".ts")).select(
        F.col("src").alias("file"),
        F.when((kind < 2) | (kind == 4), F.col("name")).when(kind == 2, F.concat(F.lit("ns_"), "type")).otherwise("*").alias("local"),
        F.when(kind < 2, F.col("name")).when(kind == 4, "x").otherwise("*").alias("imported"),
        F.when(kind < 4, F.col("file_path")).alias("target"),
        (kind == 4).alias("external"),
        "id",
    )
    first = rows.groupBy("file", "local").agg(F.min_by(F.struct("imported", "target", "external"), "id").alias("m"))
    return first.select("file", "local", "m.*")


CODE_CALLS_SQL = """SELECT a.id * 100000000 + b.id AS call_id, a.file_path AS caller_file, a.name AS caller_name, a.name_path AS caller_path, b.name AS callee_name,
    CASE (a.id + b.id) % 6 WHEN 0 THEN concat('store::', b.brand, '<T>') WHEN 1 THEN 'Self' WHEN 2 THEN concat('ns_', b.type) END AS qualifier
  FROM edges JOIN code a ON a.id = src JOIN code b ON b.id = dst"""


def code_calls(edges_: DataFrame, c: DataFrame) -> DataFrame:
    """A call per import edge: the symbol of the line before calls the name of this line's part."""
    a = c.select(
        F.col("id").alias("src"), F.col("file_path").alias("caller_file"), F.col("name").alias("caller_name"), F.col("name_path").alias("caller_path")
    )
    b = c.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), "brand", "type")
    kind = (F.col("src") + F.col("dst")) % 6
    qualifier = (
        F.when(kind == 0, F.concat(F.lit("store::"), "brand", F.lit("<T>"))).when(kind == 1, "Self").when(kind == 2, F.concat(F.lit("ns_"), "type"))
    )
    return edges_.join(a, "src").join(b, "dst").select(
        (F.col("src") * 100000000 + F.col("dst")).alias("call_id"), "caller_file", "caller_name", "caller_path", "callee_name", qualifier.alias("qualifier")
    )


# Source files: one per part, ten lines in one of four languages; what is in them follows from the part's columns.
_NL = "chr(10)"
_ID, _N, _K, _B = "CAST(p_partkey AS STRING)", "replace(p_name, ' ', '_')", "CAST(p_size AS STRING)", "lower(replace(p_brand, '#', ''))"
_TAG = "CASE p_partkey % 7 WHEN 0 THEN 'TODO' WHEN 1 THEN 'FIXME' WHEN 2 THEN 'HACK' WHEN 3 THEN 'NOTE' WHEN 4 THEN 'XXX' WHEN 5 THEN 'DEPRECATED' ELSE 'plain' END"
_FOLDER = "CASE p_partkey % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'benchmarks/' WHEN 2 THEN 'my-cli/src/' WHEN 3 THEN 'core/src/tools/' WHEN 4 THEN 'web/src/dto/' WHEN 5 THEN 'gen/generated/' ELSE 'core/src/' END"
_EXT = "CASE p_type WHEN 'ECONOMY' THEN '.rs' WHEN 'MEDIUM' THEN '.rs' WHEN 'PROMO' THEN '.ts' WHEN 'LARGE' THEN '.ts' WHEN 'SMALL' THEN '.py' ELSE '.go' END"
_BRANCHES = "repeat('if a && b {} ', CAST(p_size % 4 AS INT))"
_PY_BRANCHES = "repeat('a and b or c; ', CAST(p_size % 4 AS INT))"


def _file_lines(*lines: str) -> str:
    return f"concat({f', {_NL}, '.join(lines)})"


_CONTENT = {
    "rs": _file_lines(
        f"concat('use crate::', {_B}, '::{{', {_N}, ', other}};')", "'pub use std::fmt;'", f"concat('mod ', {_N}, ';')", f"concat('// ', {_TAG}, ': check ', {_K}, '  ')",
        "CASE WHEN p_partkey % 7 = 0 THEN '#[test]' ELSE '' END", f"concat('fn run_', {_K}, '() {{')", f"concat('    ', {_BRANCHES})", "'}'",
        f"CASE WHEN p_partkey % 3 = 0 THEN concat('pub fn ', {_N}, '(x: i32) -> i32 {{ helper_', {_K}, '(x) }}') ELSE 'let z = 1;' END", "'mod tools;'",
    ),
    "ts": _file_lines(
        f"concat('import {{ ', {_N}, ' as one, two }} from \"./', {_N}, '_', {_ID}, '\";')", "'import \"side-effect\";'", "'const r = require(\"@/lib/x\");'", f"concat('// ', {_TAG}, ': check ', {_K}, '  ')",
        "''", "CASE WHEN p_partkey % 7 = 0 THEN 'it(\"works\", () => {' ELSE 'function run() {' END", f"concat('    ', {_BRANCHES})", "'}'",
        f"CASE WHEN p_partkey % 3 = 0 THEN concat('function ', {_N}, '(x) {{ return helper_', {_K}, '(x); }}') ELSE 'let z = 1;' END", "'export * from \"../all\";'",
    ),
    "py": _file_lines(
        f"concat('import os, ', {_B}, '.', {_N}, ' as m')", f"concat('from .', {_N}, '_', {_ID}, ' import x')", "'from ..up import y'", f"concat('# ', {_TAG}, ': check ', {_K}, '  ')",
        "CASE WHEN p_partkey % 5 = 0 THEN '@cached' ELSE '' END", f"concat('def ', CASE WHEN p_partkey % 7 = 0 THEN 'test_' ELSE 'run_' END, {_K}, '(x):')", f"concat('    pass; ', {_PY_BRANCHES})", "''",
        f"CASE WHEN p_partkey % 3 = 0 THEN concat('def ', {_N}, '(x): return helper_', {_K}, '(x)') ELSE 'z = 1' END", "'class C: pass'",
    ),
    "go": _file_lines(
        f"concat('import \"example.com/', {_B}, '/', {_N}, '\"')", "'import ('", "'  \"fmt\"'", f"concat('  // ', {_TAG}, ': check ', {_K}, '  ')",
        "')'", f"concat('func ', CASE WHEN p_partkey % 7 = 0 THEN 'Test' ELSE 'Run' END, {_K}, '() {{')", f"concat('    ', {_BRANCHES})", "'}'", "'var z = 1'", "''",
    ),
}
_SOURCES = [
    "CAST(p_partkey AS BIGINT) AS id",
    f"concat({_FOLDER}, {_B}, '/', {_N}, '_', {_ID}, {_EXT}) AS relative_path",
    f"CASE {_EXT} WHEN '.rs' THEN {_CONTENT['rs']} WHEN '.ts' THEN {_CONTENT['ts']} WHEN '.py' THEN {_CONTENT['py']} ELSE {_CONTENT['go']} END AS content",
]
#: What the files were made from, for SQL that does not read their text.
FACTS_SQL = f"""SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey, p_size, {_N} AS n, {_B} AS b, substr({_EXT}, 2) AS ext, {_TAG} AS tag,
  concat({_FOLDER}, {_B}, '/', {_N}, '_', {_ID}, {_EXT}) AS relative_path FROM part""".replace("AS STRING", "AS VARCHAR")
SOURCES_SQL = f"SELECT {', '.join(_SOURCES)} FROM part".replace("AS STRING", "AS VARCHAR")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, relative_path, content): a source file per part."""
    return _spread(spark, sf_dir).selectExpr(*_SOURCES)


# Programs: one a part, in six languages, with names in strings and comments of every kind.
_PROGRAM_EXT = "CASE p_partkey % 6 WHEN 0 THEN 'rs' WHEN 1 THEN 'ts' WHEN 2 THEN 'go' WHEN 3 THEN 'java' WHEN 4 THEN 'kt' ELSE 'py' END"
_PROGRAMS = {
    "rs": (
        "// {N}() in a comment \"quote", "pub struct Ring_{K}<'a> {{ name: &'a str }}", "impl<'a> Ring_{K}<'a> {{", "    pub fn {N}(&self, x: &'a str) -> char {{",
        "        let s = \"{N}(\\\"no\\\")\"; /* {N}( /* nested */ {N}( */", "        if helper_{K}(x) {{ self.other() }} else {{ '\"' }}", "    }}", "}}",
        "fn free_{K}<F: Fn() -> u8>(f: F) {{", "    {N}(r#\"a \" {N}(\"#);", "}}",
    ),
    "ts": (
        "/* {N}() {{", " * {N} */ export class Ring_{K} extends Base {{", "  {N}(x: string): string {{",
        "    const s = `{N} ${{{N}(x)}}`; if (helper_{K}(\"//\")) {{ this.#go(); }}", "  }}", "}}", "interface Shape {{ area: number }}", "const one = (x) => {N}(x); /* {N}( */",
    ),
    "go": (
        "// {N}(", "func {N}(x string) string {{", "	s := `{N} {{", "\" {N}( ` + \"{N}(\"", "	_ = s", "	if helper_{K}(s) {{ return \"}}\" }}", "	return {N}(x) // {N}(", "}}",
        "type Ring_{K} struct {{ name string }}", "func (r *Ring_{K}) Run() bool {{ return check('{{') }}",
    ),
    "java": (
        "/** {N}() {{ */", "class Ring_{K} {{", "    int {N}(String s) throws E {{", "        s = \"\"\"", "            {N}() {{ \" \"\"\"; if (helper_{K}(s)) return 1;",
        "        return {N}(s); // {N}()", "    }}", "}}",
    ),
    "kt": (
        "/* {N}() /* {N} */ {N} */", "fun {N}(x: Int): Int {{", "    val s = \"{N}() {{\"", "    if (helper_{K}(s)) {{ }}", "    return {N}(x) // \"{N}\"", "}}",
        "class Ring_{K} {{", "    fun go() {{ check('}}') }}", "}}",
    ),
    "py": ("\"\"\"{N}() # \"\"\"", "def {N}(x, y):", "    s = '{N}' + \"{N}(\"  # it's", "    return {N}(x // y)  # {N}"),
}


def _program_sql(lines: tuple[str, ...]) -> str:
    """The lines as SQL that reads the part's columns; {N} and {K} are its name and size."""
    text = "\n".join(x.replace("{{", "\x01").replace("}}", "\x02") for x in lines)
    parts = []
    for piece in re.split(r"(\{N\}|\{K\}|\n|\\|')", text):
        plain = piece.replace("\x01", "{").replace("\x02", "}")
        special = {"{N}": _N, "{K}": _K, "\n": _NL, "\\": "chr(92)", "'": "chr(39)"}
        parts += [special.get(piece) or f"'{plain}'"] if piece else []
    return f"concat({', '.join(parts)})"


_PROGRAM_COLUMNS = [
    "CAST(p_partkey AS BIGINT) AS id",
    f"concat('prog/', {_N}, '_', {_ID}, '.', {_PROGRAM_EXT}) AS relative_path",
    f"CASE p_partkey % 6 WHEN 0 THEN {_program_sql(_PROGRAMS['rs'])} WHEN 1 THEN {_program_sql(_PROGRAMS['ts'])} WHEN 2 THEN {_program_sql(_PROGRAMS['go'])} "
    f"WHEN 3 THEN {_program_sql(_PROGRAMS['java'])} WHEN 4 THEN {_program_sql(_PROGRAMS['kt'])} ELSE {_program_sql(_PROGRAMS['py'])} END AS content",
]
#: What the programs were made from, for SQL that does not read their text.
PROGRAM_FACTS_SQL = f"SELECT CAST(p_partkey AS BIGINT) AS id, {_PROGRAM_COLUMNS[1]}, {_PROGRAM_EXT} AS ext, {_N} AS n, {_K} AS k FROM part".replace("AS STRING", "AS VARCHAR")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, relative_path, content): a program per part."""
    return _spread(spark, sf_dir).selectExpr(*_PROGRAM_COLUMNS)


# Scripts: one a part, in which a part's name is a variable of several scopes.
_SCRIPT = (
    "import {{ helper_{K} as h }} from \"./{N}\"; // {N}", "export const {N} = 1;", "let total = {N};", "function outer_{K}({N}) {{",
    "  if ({N}) {{ let total = {N}; total++; }}", "  total += h({N}); var late = \"{N}\";", "  return (x) => x + late + missing_{K};", "}}",
    "class Ring_{K} {{ run({N}, y = total) {{ return this.total + {N} + y; }} }}", "console.log({N}, outer_{K}(total));",
)
_SCRIPT_PATH = f"concat('web/', {_N}, '_', {_ID}, CASE p_partkey % 2 WHEN 0 THEN '.ts' ELSE '.js' END)"
SCRIPT_FACTS_SQL = f"SELECT {_SCRIPT_PATH} AS file_path, {_N} AS n, {_K} AS k FROM part".replace("AS STRING", "AS VARCHAR")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relative_path, content): a script per part."""
    return _spread(spark, sf_dir).selectExpr(f"{_SCRIPT_PATH} AS relative_path", f"{_program_sql(_SCRIPT)} AS content")


_DOCS = [x for x in _SYMBOLS if not x.endswith("AS file_path")] + [_SOURCES[1].replace("AS relative_path", "AS file_path"), _SOURCES[2].replace("AS content", "AS body")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, kind, line, signature, name_path, file_path, body, doc_comment, module_path, is_test, is_generated, exported)."""
    from quarry.operators.lookup import properties

    d = _spread(spark, sf_dir).selectExpr(*_DOCS)
    found = properties(F.col("file_path"), F.col("signature"), F.col("kind"))
    more = {k: v for k, v in found.items() if k != "language"} | {"doc_comment": F.split("body", "\n")[3]}
    return d.select("*", *[c.alias(k) for k, c in more.items()])


_COMMENT = "concat(CASE ext WHEN 'py' THEN '# ' WHEN 'go' THEN '  // ' ELSE '// ' END, tag, ': check ', CAST(p_size AS VARCHAR), '  ')"
DOCUMENTS_SQL = f"""SELECT s.id, s.name, s.kind, s.line, s.signature, s.name_path, f.relative_path AS file_path, so.content AS body, {_COMMENT.replace("p_size", "f.p_size")} AS doc_comment,
  replace(replace(replace(replace(replace(f.relative_path, concat('.', ext), ''), 'my-cli/src/', ''), 'core/src/', ''), 'web/src/', ''), '/', '::') AS module_path,
  starts_with(f.relative_path, 'tests/') AS is_test, starts_with(f.relative_path, 'gen/') AS is_generated, s.kind IN ('interface', 'enum') AS exported
  FROM ({SYMBOLS_SQL}) s JOIN ({FACTS_SQL}) f ON f.id = s.id JOIN ({SOURCES_SQL}) so ON so.id = s.id"""

RECENCY_SQL = "SELECT l_partkey AS id, avg(CASE WHEN l_shipdate >= TIMESTAMP '2001-07-01' THEN 1.0 ELSE 0.0 END) AS recency FROM lineitem GROUP BY 1"


def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, recency): the share of a part's lines that were shipped in the last months."""
    late = F.when(F.col("l_shipdate") >= F.lit("2001-07-01").cast("timestamp"), 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg(late).alias("recency"))


def symbol_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding): symbols with the vector of their number; a part without one has none."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vector): the batch's queries q1 to q6 have the vectors 1 to 6."""
    v = table(spark, sf_dir, "embeddings").where("vec_id BETWEEN 1 AND 6")
    return v.select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vector"))


QUERY_VECTORS_SQL = "SELECT concat('q', CAST(vec_id AS VARCHAR)) AS query_id, embedding AS vector FROM embeddings WHERE vec_id BETWEEN 1 AND 6"


_CALLS = [
    "CAST(event_id AS BIGINT) AS call_id",
    "CAST(user_id AS STRING) AS session",
    "event_type AS tool",
    "value AS elapsed_ms",
    "ts",
    "props AS args",
]
TOOL_CALLS_SQL = f"SELECT {', '.join(_CALLS)} FROM events".replace("AS STRING", "AS VARCHAR")


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call per event: the session is the user, the tool the event type."""
    return table(spark, sf_dir, "events").selectExpr(*_CALLS)


_VECTORS = [
    "CAST(vec_id AS BIGINT) AS id",
    "concat('f', CAST(label AS STRING)) AS file_path",
    "embedding",
]
VECTORS_SQL = f"SELECT {', '.join(_VECTORS)} FROM embeddings".replace("AS STRING", "AS VARCHAR")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(*_VECTORS)


def queries_frame(spark: SparkSession, queries: list[tuple[str, str]]) -> DataFrame:
    """A batch of queries as (query_id, query)."""
    return spark.createDataFrame(queries, "query_id string, query string")


def queries_sql(queries: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in queries) + ") q(query_id, query)"


#: The batch that retrieval queries are asked.
QUERIES = [
    ("q1", "small_ring"),
    ("q2", "red widget"),
    ("q3", "find blue bolt"),
    ("q4", "gear"),
    ("q5", "economy hot gear handler"),
    ("q6", "find the file that has red gears"),
]
