"""Registered lookups, listings, text scans and session analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry import storage
from quarry.functions import text as T
from quarry.operators import calls, edits, evaluation, fuzzy, lookup, modules, notebook, reports, telemetry, vector
from quarry.operators.sizes import small
from quarry.registry import register
from quarry.sources import code, git
from quarry.streaming import ingest

SY = f"sy AS ({A.SYMBOLS_SQL})"
FI = f"fi AS ({A.FILES_SQL})"

# --- lookups ---------------------------------------------------------------------------------------


@register("find_symbol_exact", f"WITH {SY} SELECT * FROM sy WHERE name IN ('small_ring', 'red_widget')")
def find_symbol_exact(spark, d):
    return lookup.exact(A.symbols(spark, d), ["small_ring", "red_widget"])


@register("find_symbol_in_file", f"WITH {SY} SELECT id, name, line FROM sy WHERE name = 'small_ring' AND file_path = 'src/brand2/economy.rs'")
def find_symbol_in_file(spark, d):
    return lookup.exact(A.symbols(spark, d), ["small_ring"], "src/brand2/economy.rs").select("id", "name", "line")


@register(
    "find_symbol_substring",
    f"WITH {SY} SELECT id, name, file_path FROM sy WHERE name ILIKE '%D_B%' ORDER BY length(name), name, id LIMIT 50",
)
def find_symbol_substring(spark, d):
    return lookup.substring(A.symbols(spark, d), "D_B", 50).select("id", "name", "file_path")


@register("name_path_lookup", f"WITH {SY} SELECT id, file_path, line FROM sy WHERE name_path = 'Brand#2/small_ring'")
def name_path_lookup(spark, d):
    return A.symbols(spark, d).where("name_path = 'Brand#2/small_ring'").select("id", "file_path", "line")


@register(
    "stable_symbol_id",
    f"""WITH {SY}, x AS (SELECT id, concat(file_path, '#', kind, ':', replace(name_path, '#', '_')) AS symbol_id FROM sy)
SELECT id, symbol_id, regexp_extract(symbol_id, '^([^#]+)#([^:]+):(.+)$', 1) AS path, regexp_extract(symbol_id, '^([^#]+)#([^:]+):(.+)$', 2) AS kind FROM x""",
)
def stable_symbol_id(spark, d):
    ident = T.symbol_id(F.col("file_path"), F.col("kind"), F.replace("name_path", F.lit("#"), F.lit("_")))
    rows = A.symbols(spark, d).select("id", ident.alias("symbol_id"))
    p = T.parse_symbol_id(F.col("symbol_id"))
    return rows.select("id", "symbol_id", p["file_path"].alias("path"), p["kind"].alias("kind"))


@register("path_scope", f"WITH {SY} SELECT id, file_path FROM sy WHERE file_path = 'src/brand2' OR file_path LIKE 'src/brand2/%'")
def path_scope(spark, d):
    return lookup.under(A.symbols(spark, d), "./src/brand2/").select("id", "file_path")


@register("path_prefix_range", f"WITH {SY} SELECT id, file_path FROM sy WHERE starts_with(file_path, 'src/brand1')")
def path_prefix_range(spark, d):
    return lookup.prefix_range(A.symbols(spark, d), "src/brand1").select("id", "file_path")


@register("kind_filter", f"WITH {SY} SELECT DISTINCT file_path FROM sy WHERE kind IN ('class', 'interface')")
def kind_filter(spark, d):
    return A.symbols(spark, d).where(F.col("kind").isin("class", "interface")).select("file_path").distinct()


@register(
    "symbols_overview",
    f"WITH {SY} SELECT file_path, count(*) AS n_symbols, string_agg(concat(kind, ' ', name), ', ' ORDER BY line, id) AS listing FROM sy GROUP BY file_path",
)
def symbols_overview(spark, d):
    return lookup.overview(A.symbols(spark, d))


@register(
    "dir_stats",
    f"""WITH {SY}, f AS (SELECT file_path, count(*) AS n FROM sy GROUP BY 1)
SELECT regexp_extract(file_path, '^(.*/)', 1) AS dir, count(*) AS files, CAST(sum(n) AS BIGINT) AS symbols FROM f GROUP BY 1""",
)
def dir_stats(spark, d):
    return lookup.dir_stats(A.symbols(spark, d))


@register(
    "file_symbol_counts",
    f"""WITH {SY}, {FI}, f AS (SELECT DISTINCT file_path FROM sy UNION SELECT 'src/empty.rs')
SELECT f.file_path, count(sy.id) AS n FROM f LEFT JOIN sy USING (file_path) GROUP BY 1""",
)
def file_symbol_counts(spark, d):
    s = A.symbols(spark, d)
    files = s.select("file_path").union(spark.createDataFrame([("src/empty.rs",)], "file_path string")).distinct()
    return files.join(s, "file_path", "left").groupBy("file_path").agg(F.count("id").alias("n"))


@register("language_counts", f"WITH {FI} SELECT language, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS chars FROM fi WHERE language IS NOT NULL GROUP BY 1")
def language_counts(spark, d):
    return A.files(spark, d).where("language IS NOT NULL").groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("chars")
    )


@register(
    "file_stats",
    f"WITH {FI} SELECT count(*) AS files, count(DISTINCT relative_path) AS paths, min(size_bytes) AS smallest, max(size_bytes) AS largest FROM fi",
)
def file_stats(spark, d):
    return A.files(spark, d).agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("relative_path").alias("paths"),
        F.min("size_bytes").alias("smallest"), F.max("size_bytes").alias("largest"),
    )


@register(
    "read_file_slice",
    f"WITH {FI}, x AS (SELECT id, string_split(content, chr(10)) AS r FROM fi) SELECT id, array_to_string(r[2:4], chr(10)) AS slice, CAST(len(r) AS BIGINT) AS total_lines FROM x",
)
def read_file_slice(spark, d):
    return lookup.file_slice(A.files(spark, d), 1, 4)


@register(
    "list_dir",
    f"""WITH {FI} SELECT string_split(relative_path, '/')[1] AS name, CASE WHEN contains(relative_path, '/') THEN 'dir' ELSE 'file' END AS kind, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM fi GROUP BY 1, 2""",
)
def list_dir(spark, d):
    return lookup.list_dir(A.files(spark, d))


@register("find_files", f"WITH {FI} SELECT id, relative_path FROM fi WHERE regexp_matches(relative_path, '(^|/)1.*\\.fr$')")
def find_files(spark, d):
    return lookup.find_files(A.files(spark, d), "1*.fr").select("id", "relative_path")


@register(
    "grep_context",
    f"""WITH {FI}, x AS (SELECT id, string_split(content, chr(10)) AS r FROM fi), l AS (SELECT id, r, unnest(range(1, len(r) + 1)) AS line_no FROM x),
m AS (SELECT id, r, line_no, r[line_no] AS line FROM l WHERE regexp_matches(r[line_no], 'tion[a-z]* the'))
SELECT id, line_no, CAST(strlen(regexp_extract(line, '^(.*?)tion[a-z]* the', 1)) + 1 AS BIGINT) AS "column", trim(line, ' ') AS line, array_to_string(r[greatest(line_no - 1, 1):line_no + 1], chr(10)) AS context FROM m""",
)
def grep_context(spark, d):
    return lookup.grep(A.files(spark, d), "tion[a-z]* the")


@register(
    "smart_grep_enclosing",
    f"""WITH fa AS ({A.FACTS_SQL}), l AS (SELECT id, unnest([4, 9]) AS line_no, ext, p_partkey FROM fa)
SELECT id, CAST(line_no AS BIGINT) AS line_no, CASE line_no WHEN 4 THEN id * 10 + 1 ELSE id * 10 + 3 END AS span_id FROM l WHERE line_no = 4 OR (p_partkey % 3 = 0 AND ext <> 'go')""",
)
def smart_grep_enclosing(spark, d):
    """Lines that say check or helper, each with the smallest of its file's three spans: all of it, a function, a wrapper."""
    f = A.sources(spark, d)
    hits = lookup.lines(f).where(F.col("line").rlike(": check |helper_"))
    points = hits.select((F.col("id") * 100 + F.col("line_no")).alias("point_id"), F.col("id").alias("file_path"), F.col("line_no").alias("at"), "line_no")
    span = lambda i, a, b: f.select(F.col("id").alias("file_path"), (F.col("id") * 10 + i).alias("span_id"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    found = lookup.enclosing(points, span(1, 1, 10).unionAll(span(2, 6, 8)).unionAll(span(3, 9, 9)))
    return found.select(F.col("file_path").alias("id"), "line_no", "span_id")


_STRINGS = """"(?:[^"\\\\]|\\\\.)*"|'(?:[^'\\\\]|\\\\.)*'""".replace("'", "''")


_NO_CODE = f"{_STRINGS}|(?://|#).*"


@register(
    "word_matches",
    f"""WITH {FI}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM fi),
c AS (SELECT id, line_no, regexp_split_to_array(regexp_replace(regexp_replace(line, '{_STRINGS}', '""', 'g'), '(//|#).*$', ''), '[^0-9A-Za-z_]+') AS w FROM l)
SELECT id, line_no, CAST(len(list_filter(w, lambda x: x = 'the')) AS BIGINT) AS matches FROM c WHERE list_contains(w, 'the')""",
)
def word_matches(spark, d):
    return lookup.word_matches(A.files(spark, d), "the")


SO = f"so AS ({A.SOURCES_SQL})"
FA = f"fa AS ({A.FACTS_SQL})"


@register(
    "find_annotations",
    f"WITH {FA} SELECT id, CAST(4 AS BIGINT) AS line_no, tag, concat('check ', CAST(p_size AS VARCHAR)) AS message FROM fa WHERE tag <> 'plain'",
)
def find_annotations(spark, d):
    return lookup.annotations(A.sources(spark, d))


@register(
    "find_tests",
    f"""WITH {FA} SELECT id, CAST(CASE ext WHEN 'rs' THEN 5 ELSE 6 END AS BIGINT) AS line_no, CASE ext WHEN 'rs' THEN '#[test]' WHEN 'ts' THEN 'it("works", () => {{'
  WHEN 'py' THEN concat('def test_', CAST(p_size AS VARCHAR), '(x):') ELSE concat('func Test', CAST(p_size AS VARCHAR), '() {{') END AS line FROM fa WHERE p_partkey % 7 = 0""",
)
def find_tests(spark, d):
    return lookup.find_tests(A.sources(spark, d))


@register(
    "branch_complexity",
    f"WITH {FA} SELECT id, CAST(1 + 2 * (p_size % 4) AS BIGINT) AS complexity FROM fa",  # two a branch, in every language
)
def branch_complexity(spark, d):
    return lookup.complexity(A.sources(spark, d))


@register(
    "symbol_complexity",
    f"""WITH {FA} SELECT id, CAST(1 AS BIGINT) AS span_id, CAST(1 + 2 * (p_size % 4) AS BIGINT) AS complexity FROM fa UNION ALL SELECT id, 2, 1 FROM fa""",
)
def symbol_complexity(spark, d):
    f = A.sources(spark, d)
    span = lambda i, a, b: f.select("id", F.lit(i).cast("long").alias("span_id"), F.lit(a).alias("start"), F.lit(b).alias("stop"))
    return lookup.complexity(f, span(1, 6, 8).unionAll(span(2, 9, 9)))


@register(
    "redundant_wrappers",
    f"""WITH {FA} SELECT id, CAST(9 AS BIGINT) AS line_no, n AS name, concat('helper_', CAST(p_size AS VARCHAR)) AS target FROM fa
WHERE p_partkey % 3 = 0 AND ext <> 'go' AND NOT starts_with(relative_path, 'tests/')""",
)
def redundant_wrappers(spark, d):
    return lookup.redundant_wrappers(A.sources(spark, d))


@register("phantom_modules", f"WITH {FA} SELECT n AS module, relative_path FROM fa WHERE ext = 'rs'")
def phantom_modules(spark, d):
    return lookup.phantom_modules(A.sources(spark, d))


@register(
    "import_extraction",
    f"""WITH {FA}, i AS (
  SELECT id, unnest([n, 'tools', concat('crate::', b, '::', n), concat('crate::', b, '::other'), 'std::fmt']) AS raw_import FROM fa WHERE ext = 'rs'
  UNION ALL SELECT id, unnest([concat('./', n, '_', CAST(id AS VARCHAR)), 'side-effect', '@/lib/x', '../all']) FROM fa WHERE ext = 'ts'
  UNION ALL SELECT id, unnest(['os', concat(b, '.', n), concat('.', n, '_', CAST(id AS VARCHAR)), '..up']) FROM fa WHERE ext = 'py'
  UNION ALL SELECT id, unnest([concat('example.com/', b, '/', n), 'fmt']) FROM fa WHERE ext = 'go')
SELECT i.id, raw_import, CASE WHEN ends_with(raw_import, concat(n, '_', CAST(fa.id AS VARCHAR))) THEN relative_path END AS target FROM i JOIN fa ON fa.id = i.id""",
)
def import_extraction(spark, d):
    files = A.sources(spark, d)
    return modules.resolve(modules.extract(files), files).select("id", "raw_import", "target")


@register(
    "module_bindings",
    f"""WITH {FA} SELECT relative_path AS file, 'one' AS local, n AS imported, relative_path AS target, false AS external FROM fa WHERE ext = 'ts'
UNION ALL SELECT relative_path, 'two', 'two', relative_path, false FROM fa WHERE ext = 'ts' UNION ALL SELECT relative_path, '*', '*', NULL, false FROM fa WHERE ext = 'ts'""",
)
def module_bindings(spark, d):
    files = A.sources(spark, d)
    return calls.bind(calls.module_clauses(files), modules.resolve(modules.extract(files), files))


@register(
    "page_links",
    """SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS raw_import FROM pages""",
)
def page_links(spark, d):
    pages = A.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("page.html").alias("relative_path"), F.col("html").alias("content"))
    return modules.extract(pages).select("id", "raw_import")


@register(
    "co_target_pages",
    """WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS t FROM pages)
SELECT t AS target, count(*) AS pages FROM l GROUP BY t HAVING count(*) > 1""",
)
def co_target_pages(spark, d):
    links = page_links(spark, d)
    return links.groupBy(F.col("raw_import").alias("target")).agg(F.count(F.lit(1)).alias("pages")).where("pages > 1")


@register(
    "symbol_properties",
    f"""WITH {FA} SELECT id, CASE ext WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'go' END AS language,
  replace(replace(replace(replace(relative_path, concat('.', ext), ''), 'my-cli/src/', ''), 'core/src/', ''), 'web/src/', '').replace('/', '::') AS module_path,
  starts_with(relative_path, 'tests/') AS is_test, starts_with(relative_path, 'gen/') AS is_generated, ext = 'rs' AND p_partkey % 3 = 0 AS exported FROM fa""",
)
def symbol_properties(spark, d):
    wrapper = F.split("content", "\n")[8]
    s = A.sources(spark, d).select("id", F.col("relative_path").alias("file_path"), wrapper.alias("signature"), F.lit("function").alias("kind"))
    return lookup.described(s)


@register(
    "path_provenance",
    f"""WITH {FA} SELECT id, CASE split_part(relative_path, '/', 1) WHEN 'benchmarks' THEN 'benchmark' WHEN 'my-cli' THEN 'surface'
  ELSE CASE WHEN contains(relative_path, '/src/tools/') THEN 'tool' ELSE 'core' END END AS role FROM fa""",
)
def path_provenance(spark, d):
    return A.sources(spark, d).select("id", T.provenance(F.col("relative_path")).alias("role"))


@register(
    "identifier_functions",
    f"""WITH {SY} SELECT id, trim(replace(name, '_', ' ')) AS words, concat('fn ', name, ' ', split_part(replace(file_path, '.rs', ''), '/', 3)) AS tokens,
  regexp_matches(lower(name), '(^|[^0-9a-z])ring([^0-9a-z]|$)') AS has_ring, sha256(name_path) AS hash FROM sy""",
)
def identifier_functions(spark, d):
    return A.symbols(spark, d).select(
        "id", T.split_identifier(F.col("name")).alias("words"), T.lexical_tokens(F.col("signature")).alias("tokens"),
        T.has_word(F.col("name"), F.lit("ring")).alias("has_ring"), F.sha2("name_path", 256).alias("hash"),
    )


_ROLES = """CASE p_size % 6 WHEN 0 THEN 'ci.yml' WHEN 1 THEN 'src/lib.rs' WHEN 2 THEN 'a/user_handler.rs' WHEN 3 THEN 'a/tests/x.rs' WHEN 4 THEN 'a/handler_map.rs' ELSE 'web/package.json' END"""


@register(
    "duplicate_thresholds",
    """SELECT CAST(p_partkey AS BIGINT) AS id, CAST(CASE WHEN p_size % 6 IN (0, 5) THEN 0.95 ELSE 0.85 END AS DOUBLE) AS threshold,
  CAST(CASE p_size % 6 WHEN 1 THEN 0.15 WHEN 2 THEN 0.10 WHEN 3 THEN 0.15 ELSE 0.0 END AS DOUBLE) AS boost FROM part""",
)
def duplicate_thresholds(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.expr(_ROLES).alias("other"))
    return p.select("id", T.duplicate_threshold(0.85, F.lit("src/a.rs"), F.col("other")).alias("threshold"), T.role_boost(F.col("other")).alias("boost"))


@register(
    "confidence_cards",
    f"""WITH {SY}, x AS (SELECT id, kind, (id % 11) / 10.0 AS coverage, id % 2 = 0 AS hit, id % 4 AS terms, kind IN ('interface', 'enum') AS exported FROM sy)
SELECT id, CASE WHEN coverage >= 0.8 AND hit THEN 'high' WHEN hit OR terms >= 2 THEN 'medium' ELSE 'low' END AS tier,
  CASE WHEN kind IN ('function', 'method') THEN CASE WHEN exported THEN 'callers,impact,body' ELSE 'callers,body' END WHEN kind IN ('class', 'interface', 'enum') THEN 'overview,hierarchy' ELSE 'references' END AS follow_up FROM x""",
)
def confidence_cards(spark, d):
    c = F.col
    return A.symbols(spark, d).select(
        "id", T.confidence((c("id") % 11) / 10, c("id") % 2 == 0, c("id") % 4).alias("tier"),
        T.follow_up(c("kind"), c("kind").isin("interface", "enum")).alias("follow_up"),
    )


@register(
    "byte_offsets",
    """SELECT doc_id, hex(encode(text)[3:6]) AS bytes_2_to_6, CAST(strlen(text) AS BIGINT) AS bytes,
  CAST(1 + len(list_filter(range(1, CAST(strlen(text) // 2 + 1 AS BIGINT)), lambda i: encode(text)[i:i] = '\\x0A'::BLOB)) AS BIGINT) AS middle_line
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
)
def byte_offsets(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.octet_length("text") / 2).cast("int")
    return t.select(
        "doc_id", F.hex(F.substring(F.col("text").cast("binary"), 3, 4)).alias("bytes_2_to_6"),
        F.octet_length("text").cast("long").alias("bytes"), T.byte_line(F.col("text"), half).cast("long").alias("middle_line"),
    )


@register(
    "content_hash_groups",
    "SELECT sha256(text) AS hash, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def content_hash_groups(spark, d):
    return A.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(
        F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first")
    ).where("files > 1")


# --- tables that are kept up to date ---------------------------------------------------------------


@register(
    "changed_files",
    """WITH u AS (SELECT l_suppkey * 100 + l_partkey % 100 AS file, l_returnflag AS status, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS p FROM lineitem)
SELECT file, min_by(status, p) AS status FROM u GROUP BY file""",
)
def changed_files(spark, d):
    p = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    file = (F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).alias("file")
    rows = A.table(spark, d, "lineitem").select(file, F.col("l_returnflag").alias("status"), p.alias("p"))
    return lookup.first_wins(rows, "file", "p").select("file", "status")


_NAMED = "concat(l_returnflag, CASE l_returnflag WHEN 'R' THEN concat('100', chr(9), 'old/', CAST(l_partkey AS STRING)) ELSE '' END, chr(9), 'src/', CAST(l_partkey AS STRING), '.rs') AS line"
_SHORT = "concat(' ', CASE l_linestatus WHEN 'O' THEN 'M' ELSE 'D' END, ' src/', CAST(l_partkey % 3000 AS STRING), '.rs') AS line"


@register(
    "changed_files_from_listings",
    """WITH a AS (SELECT concat('src/', CAST(l_partkey AS VARCHAR), '.rs') AS file, min(l_returnflag) AS status FROM lineitem WHERE l_quantity > 45 GROUP BY 1),
b AS (SELECT concat('src/', CAST(l_partkey % 3000 AS VARCHAR), '.rs') AS file, min(CASE l_linestatus WHEN 'O' THEN 'M' ELSE 'D' END) AS status FROM lineitem GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE file NOT IN (SELECT file FROM a)""",
)
def changed_files_from_listings(spark, d):
    """A name-status listing of large lines, then the short status of all."""
    rows = A.table(spark, d, "lineitem")
    return git.changed([git.name_status(rows.where("l_quantity > 45").selectExpr(_NAMED)), git.porcelain(rows.selectExpr(_SHORT))])


@register(
    "commit_log_files",
    "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS commit_id, concat('c', CAST(o_custkey AS VARCHAR)) AS author, CAST(epoch(o_orderdate) AS BIGINT) AS at, concat('s', CAST(l_suppkey AS VARCHAR)) AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
)
def commit_log_files(spark, d):
    """The log of all orders: a text a customer, a block an order, a line a supplier."""
    files = A.commits(spark, d).groupBy("commit_id").agg(F.array_join(F.sort_array(F.collect_list("file")), "\n").alias("files"))  # an order's lines
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"))
    head = F.concat_ws("\t", F.lit("commit"), F.col("commit_id").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("at").cast("string"))
    blocks = files.join(o, "commit_id").select("o_custkey", F.concat(head, F.lit("\n"), "files", F.lit("\n\n")).alias("block"))
    return git.commit_log(blocks.groupBy("o_custkey").agg(F.array_join(F.collect_list("block"), "").alias("text")))


@register(
    "diff_symbols",
    f"""WITH {SY}, c AS (SELECT DISTINCT file_path FROM sy WHERE line = 7 UNION SELECT 'src/gone.rs')
SELECT c.file_path, count(sy.id) AS n, coalesce(string_agg(sy.name, ',' ORDER BY sy.line, sy.id), '') AS names FROM c LEFT JOIN sy ON sy.file_path = c.file_path AND kind NOT IN ('file', 'variable') GROUP BY 1""",
)
def diff_symbols(spark, d):
    s = A.symbols(spark, d)
    ch = s.where("line = 7").select("file_path").union(spark.createDataFrame([("src/gone.rs",)], "file_path string")).distinct()
    real = s.where(~F.col("kind").isin("file", "variable"))
    listed = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("line", "id", "name"))))
    return ch.join(real, "file_path", "left").groupBy("file_path").agg(
        F.count("id").alias("n"), F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("names")
    )


# Two states of a table: what was ordered up to a day, and all there is, returned lines counting as changed.
_STATES = """o AS (SELECT l_partkey AS key, count(*) AS hash FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01' GROUP BY 1),
n AS (SELECT p_partkey AS key, coalesce(c, 0) AS hash FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c FROM lineitem
  WHERE l_shipdate < TIMESTAMP '1995-03-01' OR l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY 1) ON l_partkey = p_partkey WHERE p_size > 5)"""


def _states(spark, d):
    lines = A.table(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1995-03-01").cast("timestamp")
    late = F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp")
    count = lambda when: lines.where(when).groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("hash"))
    parts = A.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("key"))
    return count(early), parts.join(count(early | late), "key", "left").select("key", F.coalesce("hash", F.lit(0)).cast("long").alias("hash"))


@register("upsert_files", f"WITH {_STATES} SELECT key, hash FROM n UNION ALL SELECT key, hash FROM o WHERE key NOT IN (SELECT key FROM n)")
def upsert_files(spark, d):
    return lookup.upsert(*_states(spark, d), "key")


@register(
    "upsert_cascade",
    f"""WITH {_STATES}, gone AS (SELECT o.key FROM o LEFT JOIN n USING (key) WHERE n.key IS NULL OR n.hash <> o.hash),
c AS (SELECT l_orderkey, l_linenumber, l_partkey AS key FROM lineitem)
SELECT key, count(*) AS children FROM c WHERE key NOT IN (SELECT key FROM gone) GROUP BY 1""",
)
def upsert_cascade(spark, d):
    old, new = _states(spark, d)
    children = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"))
    return lookup.keep_children(children, old, new, "key", "hash").groupBy("key").agg(F.count(F.lit(1)).alias("children"))


@register(
    "index_coverage",
    f"""WITH {_STATES}, c AS (SELECT count(*) FILTER (n.hash = o.hash) AS ready, count(*) FILTER (n.hash <> o.hash) AS stale, count(*) FILTER (o.key IS NULL) AS missing,
  count(*) FILTER (n.key IS NULL) AS extra FROM n FULL JOIN o ON n.key = o.key)
SELECT ready, stale, missing, extra, CAST(CASE WHEN ready + stale + missing > 0 THEN floor(ready * 100 / (ready + stale + missing)) ELSE 0 END AS BIGINT) AS percent FROM c""",
)
def index_coverage(spark, d):
    return lookup.coverage(*_states(spark, d))


_FAILED = """f AS (SELECT user_id AS file, max(ts) FILTER (event_type = 'error') AS failed_at, count(*) FILTER (event_type = 'error') AS retries,
  max(ts) FILTER (event_type = 'purchase') AS cleared_at FROM events GROUP BY 1), g AS (SELECT * FROM f WHERE retries > 0 AND (cleared_at IS NULL OR cleared_at < failed_at))"""


def _failures(spark, d):
    """A failure per error event, cleared by a later purchase of the same user."""
    rows = A.table(spark, d, "events").select(F.col("user_id").alias("file"), "ts", (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("done"))
    return lookup.failures(rows)


@register(
    "failure_log",
    f"WITH {_FAILED} SELECT file, failed_at, retries FROM g",
)
def failure_log(spark, d):
    return _failures(spark, d)


@register(
    "failure_summary",
    f"""WITH {_FAILED} SELECT count(*) AS total, count(*) FILTER (failed_at >= TIMESTAMP '2024-01-20') AS recent, count(*) FILTER (retries >= 3) AS persistent,
  count(*) FILTER (failed_at < TIMESTAMP '2024-01-20' AND retries < 3) AS stale FROM g""",
)
def failure_summary(spark, d):
    return lookup.failure_summary(_failures(spark, d), F.lit("2024-01-20").cast("timestamp"))


@register("prune_failures", f"WITH {_FAILED} SELECT file FROM g WHERE file IN (SELECT c_custkey FROM customer)")
def prune_failures(spark, d):
    known = A.table(spark, d, "customer").select(F.col("c_custkey").alias("file"))
    return _failures(spark, d).join(known, "file", "left_semi").select("file")


@register(
    "federated_symbols",
    "SELECT 'parts' AS project, CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part WHERE p_name = 'small ring' UNION ALL SELECT 'suppliers', CAST(s_suppkey AS BIGINT), s_name FROM supplier WHERE s_name LIKE '%7'",
)
def federated_symbols(spark, d):
    p = A.table(spark, d, "part").where("p_name = 'small ring'").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    s = A.table(spark, d, "supplier").where(F.col("s_name").endswith("7")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return code.federated({"parts": p, "suppliers": s}).select("project", "id", "name")


@register(
    "surface_consistency",
    "WITH a AS (SELECT DISTINCT concat(p_name, ' ', CAST(p_size AS VARCHAR)) AS t FROM part WHERE p_brand < 'Brand#2'), b AS (SELECT DISTINCT concat(p_name, ' ', CAST(p_size AS VARCHAR)) AS t FROM part WHERE p_brand >= 'Brand#2') "
    "SELECT 'only_defined' AS side, t AS name FROM a WHERE t NOT IN (SELECT t FROM b) UNION ALL SELECT 'only_dispatched', t FROM b WHERE t NOT IN (SELECT t FROM a)",
)
def surface_consistency(spark, d):
    p = A.table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), "p_brand")
    return lookup.one_sided(p.where("p_brand < 'Brand#2'"), p.where("p_brand >= 'Brand#2'"), "name")


@register(
    "rename_plan",
    f"""WITH {FI}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM fi),
c AS (SELECT id, line_no, line, regexp_split_to_array(line, '{_NO_CODE}') AS b, regexp_extract_all(line, '{_NO_CODE}') AS f FROM l WHERE contains(line, 'the'))
SELECT id, line_no, line AS before, array_to_string(list_transform(range(1, len(b) + 1), lambda i: concat(regexp_replace(b[i], '\\bthe\\b', 'THE', 'g'), coalesce(f[i], ''))), '') AS after
FROM c WHERE len(list_filter(b, lambda x: regexp_matches(x, '\\bthe\\b'))) > 0""",
)
def rename_plan(spark, d):
    return edits.rename(A.files(spark, d), "the", "THE")


@register("insert_plan", f"WITH {SY} SELECT id, file_path, line + 1 AS line, '// checked' AS after FROM sy WHERE name = 'small_ring'")
def insert_plan(spark, d):
    return edits.insert(A.symbols(spark, d), "small_ring", "// checked", before=False)


# --- session analytics -----------------------------------------------------------------------------


def _tools(spark, d):
    return A.tool_calls(spark, d).withColumn("failed", F.col("tool") == "error")


@register(
    "tool_metrics",
    "SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total_ms, max(value) AS max_ms, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1",
)
def tool_metrics(spark, d):
    m = telemetry.metrics(_tools(spark, d)).drop("last_called")
    return m.withColumn("mean_ms", F.round(F.col("total_ms") / F.col("calls"), 4))


@register(
    "tool_p95",
    """WITH r AS (SELECT event_type AS tool, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
v AS (SELECT tool, list(value ORDER BY value) AS v FROM r WHERE n <= 256 GROUP BY tool)
SELECT tool, v[(len(v) - 1) * 95 // 100 + 1] AS p95_ring, v[CAST(ceil(len(v) * 0.95) AS INT)] AS p95_harness FROM v""",
)
def tool_p95(spark, d):
    return telemetry.p95(A.tool_calls(spark, d))


@register(
    "rate_limit",
    """SELECT event_id AS call_id, earlier, earlier > 2 AS rejected FROM (SELECT event_id,
  count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) - row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) ORDER BY event_id DESC) AS earlier FROM events)""",
)
def rate_limit(spark, d):
    return telemetry.rate_limited(A.tool_calls(spark, d), 2, 3_600_000).select("call_id", "earlier", "rejected")


@register(
    "doom_loops",
    """WITH x AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM x)
SELECT CAST(user_id AS VARCHAR) AS session, CAST(run AS BIGINT) AS run, min(event_type) AS tool, count(*) AS length FROM y GROUP BY user_id, run HAVING count(*) >= 3""",
)
def doom_loops(spark, d):
    return telemetry.doom_loops(A.tool_calls(spark, d).withColumn("args", F.lit("")))


@register(
    "suggestion_outcomes",
    """WITH x AS (SELECT event_type AS tool, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT tool, count(*) FILTER (nx IN ('click', 'purchase')) AS accepted, count(*) FILTER (nx NOT IN ('click', 'purchase')) AS diverted FROM x WHERE nx IS NOT NULL AND tool = 'view' GROUP BY 1
UNION ALL SELECT tool, count(*) FILTER (nx = 'view'), count(*) FILTER (nx <> 'view') FROM x WHERE nx IS NOT NULL AND tool = 'signup' GROUP BY 1""",
)
def suggestion_outcomes(spark, d):
    return telemetry.suggestions(A.tool_calls(spark, d), {"view": ["click", "purchase"], "signup": ["view"]})


@register(
    "tool_usage",
    """WITH g AS (SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY 1), t AS (SELECT *, round(calls / sum(calls) OVER (), 6) AS share FROM g)
SELECT tool, calls, CAST(share AS DOUBLE) AS share, CASE WHEN share >= 0.25 THEN 'heavy' WHEN share >= 0.05 THEN 'regular' ELSE 'rare' END AS bucket FROM t""",
)
def tool_usage(spark, d):
    return telemetry.usage(A.tool_calls(spark, d))


@register(
    "verifier_status",
    "SELECT n_regionkey AS subject, CASE max(n_nationkey % 3) WHEN 0 THEN 'ready' WHEN 1 THEN 'caution' ELSE 'blocked' END AS status FROM nation GROUP BY 1",
)
def verifier_status(spark, d):
    level = F.when(F.col("n_nationkey") % 3 == 0, "ready").when(F.col("n_nationkey") % 3 == 1, "caution").otherwise("blocked")
    return telemetry.worst_status(A.table(spark, d, "nation").select(F.col("n_regionkey").alias("subject"), level.alias("status")))


_JOBS = "j AS (SELECT CAST(user_id AS VARCHAR) AS job, ts AS moment, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'cancelled' END AS state FROM events)"


def _jobs(spark, d):
    names = {"signup": "queued", "view": "running", "purchase": "completed", "error": "error", "click": "cancelled"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return A.tool_calls(spark, d).select(F.col("session").alias("job"), F.col("ts").alias("at"), F.col("call_id").alias("seq"), m[F.col("tool")].alias("state"))


@register(
    "invalid_transitions",
    f"""WITH {_JOBS}, x AS (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY moment, seq) AS before FROM j)
SELECT job, seq, before, state FROM x WHERE before IS NOT NULL AND concat(before, '>', state) NOT IN ({", ".join(f"'{a}>{b}'" for a, b in telemetry.TRANSITIONS)})""",
)
def invalid_transitions(spark, d):
    return telemetry.invalid_transitions(_jobs(spark, d)).select("job", "seq", "before", "state")


@register("analysis_jobs", f"WITH {_JOBS} SELECT job, state FROM j QUALIFY row_number() OVER (PARTITION BY job ORDER BY moment DESC, seq DESC) = 1")
def analysis_jobs(spark, d):
    return telemetry.latest(_jobs(spark, d)).select("job", "state")


@register(
    "claim_overlap",
    """WITH c AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 48)
SELECT CAST(a.s AS VARCHAR) AS a, CAST(b.s AS VARCHAR) AS b, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND CAST(a.s AS VARCHAR) < CAST(b.s AS VARCHAR) GROUP BY 1, 2""",
)
def claim_overlap(spark, d):
    c = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("session_id"), F.array(F.col("l_partkey")).alias("paths"),
        F.when(F.col("l_quantity") > 48, 10).otherwise(0).alias("expires_at"),
    )
    return telemetry.overlapping_claims(c, 5)


@register("active_agents", "SELECT user_id, count(*) AS n FROM events WHERE (epoch_us(ts) // 1000) + 300000 > 1705000000000 GROUP BY 1")
def active_agents(spark, d):
    rows = A.table(spark, d, "events").withColumn("expires_at", F.unix_millis(F.col("ts").cast("timestamp")) + 300000)
    return ingest.live(rows, 1705000000000).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "paginate",
    f"WITH {SY}, x AS (SELECT id, name, row_number() OVER (ORDER BY name, id) AS position FROM sy) SELECT * FROM x WHERE position > 20 AND position <= 30",
)
def paginate(spark, d):
    return telemetry.page(A.symbols(spark, d).select("id", "name"), ["name", "id"], 20, 10)


@register(
    "compression_stage",
    "SELECT doc_id, CASE WHEN s < 75 THEN 0 WHEN s < 85 THEN 1 WHEN s < 95 THEN 2 WHEN s <= 100 THEN 3 ELSE 4 END AS stage FROM (SELECT doc_id, strlen(text) * 100 / 3000 AS s FROM documents)",
)
def compression_stage(spark, d):
    return A.table(spark, d, "documents").select("doc_id", telemetry.compression_stage(F.octet_length("text"), F.lit(3000)).alias("stage"))


@register(
    "session_windows",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS c FROM events),
y AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT CAST(user_id AS VARCHAR) AS session, (epoch_us(min(ts)) // 1000) AS start_ms, count(*) AS calls FROM y GROUP BY user_id, s""",
)
def session_windows(spark, d):
    return telemetry.sessions(A.tool_calls(spark, d)).select("session", F.unix_millis(F.col("w.start").cast("timestamp")).alias("start_ms"), "calls")


@register(
    "memory_staleness",
    "SELECT user_id AS note, CAST(date_diff('second', max(ts), TIMESTAMP '2024-03-01') > 14 * 86400 AS BOOLEAN) AS stale FROM events GROUP BY 1",
)
def memory_staleness(spark, d):
    notes = A.table(spark, d, "events").groupBy(F.col("user_id").alias("note")).agg(F.max("ts").alias("updated_at"))
    return notebook.listed(notes, F.lit("2024-03-01").cast("timestamp")).select("note", "stale")


@register(
    "audit_log_query",
    "SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' ORDER BY event_id LIMIT 100",
)
def audit_log_query(spark, d):
    rows = A.table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return rows.orderBy("event_id").limit(100).select("event_id", "event_type", "value")


@register(
    "timeline_export",
    """WITH r AS (SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 200)
SELECT conv_id, string_agg(concat(CAST(turn AS VARCHAR), ' ', role), '; ' ORDER BY turn) AS timeline FROM r GROUP BY 1""",
)
def timeline_export(spark, d):
    rows = A.table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.col("role").alias("tool"))
    return telemetry.timeline(rows, 200).select(F.col("session").alias("conv_id"), "timeline")


@register(
    "latency_percentiles",
    """WITH r AS (SELECT event_type AS "group", value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT "group", round(avg(ms), 4) AS avg_ms, max(CASE WHEN i = greatest(ceil(n * 0.95), 1) THEN ms END) AS p95_ms FROM r GROUP BY 1""",
)
def latency_percentiles(spark, d):
    return evaluation.latency(A.tool_calls(spark, d).select(F.col("tool").alias("group"), F.col("elapsed_ms").alias("ms")))


_FILE_A = "CASE p_size % 3 WHEN 0 THEN 'ci.yml' WHEN 1 THEN 'src/a.rs' ELSE 'src/b.rs' END AS file_a"
_FILE_B = "CASE p_partkey % 4 WHEN 0 THEN 'x.json' WHEN 1 THEN 'src/a.rs' ELSE 'src/c.rs' END AS file_b"
_NAME_A, _NAME_B = "CASE p_partkey % 5 WHEN 0 THEN 'env' ELSE p_type END AS name_a", "CASE p_size % 2 WHEN 0 THEN 'steps' ELSE p_type END AS name_b"
_KIND_A, _KIND_B = "CASE p_partkey % 3 WHEN 0 THEN 'variable' ELSE 'function' END AS kind_a", "CASE p_size % 5 WHEN 0 THEN 'function' ELSE 'field' END AS kind_b"


@register(
    "duplicate_noise_filters",
    f"""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, {_FILE_A}, {_FILE_B}, {_NAME_A}, {_NAME_B}, {_KIND_A}, {_KIND_B}, p_size % 10 / 10.0 AS jaccard FROM part)
SELECT id, CASE WHEN file_a = 'ci.yml' AND file_b = 'x.json' THEN 'config_config'
  WHEN file_a = 'ci.yml' AND file_b <> 'x.json' AND name_a = 'env' THEN 'config_code' WHEN file_a <> 'ci.yml' AND file_b = 'x.json' AND name_b = 'steps' THEN 'config_code'
  WHEN file_a = file_b AND name_a = name_b THEN 'same_symbol' WHEN file_a = file_b AND kind_a = 'variable' AND kind_b = 'field' THEN 'same_file_data'
  WHEN jaccard < 0.5 THEN 'signature_only' ELSE 'kept' END AS reason FROM p""",
)
def duplicate_noise_filters(spark, d):
    p = A.table(spark, d, "part").select(
        F.col("p_partkey").cast("long").alias("id"), *[F.expr(x) for x in (_FILE_A, _FILE_B, _NAME_A, _NAME_B, _KIND_A, _KIND_B)],
        (F.col("p_size") % 10 / 10).alias("jaccard"), F.lit(0.9).alias("similarity"),
    )
    return p.select("id", vector.noise().alias("reason"))


_EVENTS_SQL = """SELECT l_orderkey AS batch, concat('d', CAST(l_suppkey % 3 AS VARCHAR), '/f', CAST(l_partkey % 20 AS VARCHAR), '.rs') AS path,
  CASE l_returnflag WHEN 'A' THEN 'deleted' WHEN 'R' THEN 'created' ELSE 'modified' END AS kind FROM lineitem"""


@register(
    "file_event_normalization",
    f"""WITH e AS (SELECT DISTINCT *, split_part(path, '/', 2) AS n FROM ({_EVENTS_SQL})),
p AS (SELECT a.batch, a.path AS from_path, b.path FROM (SELECT batch, n, min(path) AS path FROM e WHERE kind = 'deleted' GROUP BY 1, 2) a
  JOIN (SELECT batch, n, min(path) AS path FROM e WHERE kind = 'created' GROUP BY 1, 2) b ON a.batch = b.batch AND a.n = b.n AND a.path <> b.path)
SELECT batch, 'renamed' AS kind, path, from_path FROM p UNION ALL SELECT batch, kind, path, NULL FROM e
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.batch = e.batch AND ((kind = 'created' AND p.path = e.path) OR (kind = 'deleted' AND p.from_path = e.path)))""",
)
def file_event_normalization(spark, d):
    path = F.concat(F.lit("d"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/f"), (F.col("l_partkey") % 20).cast("string"), F.lit(".rs"))
    kind = F.when(F.col("l_returnflag") == "A", "deleted").when(F.col("l_returnflag") == "R", "created").otherwise("modified")
    return ingest.normalize(A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), path.alias("path"), kind.alias("kind")))


# --- more lookups ----------------------------------------------------------------------------------


@register(
    "fuzzy_symbol_search",
    f"""WITH {SY}, q AS ({A.queries_sql(A.QUERIES)}), n AS (SELECT DISTINCT name FROM sy),
s AS (SELECT query_id, name, round(jaro_winkler_similarity(lower(name), lower(query)) * 100, 4) AS score FROM n JOIN q ON contains(lower(name), lower(query)[1:2]))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) AS rank FROM s WHERE score >= 80) WHERE rank <= 10""",
)
def fuzzy_symbol_search(spark, d):
    return fuzzy.fuzzy(A.symbols(spark, d), A.queries_frame(spark, A.QUERIES))


@register(
    "word_at_position",
    f"""WITH {FI}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM fi)
SELECT id, line_no, regexp_extract(line[1:4], '[A-Za-z0-9_]*$') || regexp_extract(line[5:], '^[A-Za-z0-9_]*') AS word FROM l
WHERE regexp_extract(line[1:4], '[A-Za-z0-9_]*$') || regexp_extract(line[5:], '^[A-Za-z0-9_]*') <> ''""",
)
def word_at_position(spark, d):
    f = A.files(spark, d)
    points = lookup.lines(f).select("id", "line_no", F.lit(5).alias("column"))  # a point in every line
    return lookup.word_at(f, points).select("id", "line_no", "word")


@register(
    "text_references",
    f"""WITH {FA}, r AS (SELECT id, unnest(CASE ext WHEN 'rs' THEN [1, 3, 9] WHEN 'go' THEN [1] ELSE [1, 9] END) AS line_no, ext, p_partkey FROM fa WHERE n = 'small_ring'),
k AS (SELECT id, line_no, line_no = 9 AS is_declaration FROM r WHERE (line_no <> 9 OR p_partkey % 3 = 0) AND NOT (line_no = 1 AND ext = 'go'))
SELECT id, CAST(line_no AS BIGINT) AS line_no, CAST(1 AS BIGINT) AS matches, is_declaration, CASE WHEN is_declaration THEN id * 10 + 3 END AS enclosing FROM k
WHERE id = (SELECT min(id) FROM k WHERE is_declaration) OR id NOT IN (SELECT id FROM k WHERE is_declaration)""",
)
def text_references(spark, d):
    f = A.sources(spark, d)
    declares = r"(?:fn|def|function) small_ring\("
    decl = lookup.lines(f).where(F.col("line").rlike(declares)).select("id", F.lit("small_ring").alias("name"), F.col("line_no").alias("line"))
    spans = f.select("id", (F.col("id") * 10 + 3).alias("span_id"), F.lit(9).alias("start"), F.lit(9).alias("stop"))
    return lookup.text_references(f, decl, "small_ring", spans)


@register("decorated_symbols", f"WITH {FA} SELECT id, CAST(6 AS BIGINT) AS line_no FROM fa WHERE ext = 'py' AND p_partkey % 5 = 0")
def decorated_symbols(spark, d):
    f = A.sources(spark, d)
    return lookup.decorated(f, lookup.lines(f).where(F.col("line").rlike("^(def|func|function) ")).select("id", "line_no"))


_RANGES = "rg AS (SELECT CAST(p_partkey AS BIGINT) AS id, concat(p_brand, p_type) AS file_path, p_size * 10 AS s, p_size * 10 + 5 + (p_partkey % 7) * 40 AS e FROM part)"


@register(
    "symbol_nesting",
    f"""WITH {_RANGES} SELECT a.file_path, a.id, arg_min(b.id, (b.e - b.s) * 10000000 + b.id) AS parent_id FROM rg a
LEFT JOIN rg b ON a.file_path = b.file_path AND a.id <> b.id AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e) GROUP BY 1, 2""",
)
def symbol_nesting(spark, d):
    p = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_brand", "p_type").alias("file_path"), (F.col("p_size") * 10).alias("start_byte"),
        (F.col("p_size") * 10 + 5 + (F.col("p_partkey") % 7) * 40).alias("end_byte"),
    )
    return lookup.nested(p)


@register(
    "nested_name_paths",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 2 THEN p_partkey // 2 END AS up, p_type AS name FROM part),
t(id, up, path) AS (SELECT id, up, name FROM n UNION ALL SELECT t.id, n.up, concat(n.name, '/', t.path) FROM t JOIN n ON n.id = t.up)
SELECT id, path AS name_path FROM t WHERE up IS NULL""",
)
def nested_name_paths(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    tree = p.select("id", F.when(F.col("id") >= 2, F.floor(F.col("id") / 2).cast("long")).alias("parent_id"))
    return lookup.name_paths(tree, p)


@register(
    "import_upsert",
    "SELECT l_orderkey, l_suppkey, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2",
)
def import_upsert(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"))
    return lookup.last_wins(rows, ["l_orderkey", "l_suppkey"], "o").select("l_orderkey", "l_suppkey", "l_partkey")


@register(
    "listing_cursor",
    f"""WITH {SY}, p AS (SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS place FROM sy)
SELECT id, name, place FROM p WHERE place BETWEEN 40 AND 59""",
)
def listing_cursor(spark, d):
    s = A.symbols(spark, d).select("id", "name")
    return lookup.page(s, ["name", "id"], lookup.cursor(s, ["name", "id"], 40), 20)


@register(
    "hashed_embeddings",
    f"""WITH {SY} SELECT id, CAST(64 AS BIGINT) AS dims, CAST(1.0 AS DOUBLE) AS norm, min(id) OVER (PARTITION BY name, signature) AS twin FROM sy""",
)
def hashed_embeddings(spark, d):
    """Equal texts have equal vectors, and no others: each with the least symbol of the same vector."""
    # read through an exchange: the parts are a few bytes of one file, and one task
    s = A.symbols(spark, d).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    v = storage.written(lookup.hashed_vectors(s.select("id", F.concat_ws(" ", "name", "signature").alias("text"))), "hashed")  # read for twins, and for rows
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    twin = v.groupBy("embedding").agg(F.min("id").alias("twin"))
    return v.join(small(storage.written(twin, "twins")), "embedding").select("id", F.size("embedding").cast("long").alias("dims"), F.round(norm, 4).alias("norm"), "twin")


@register(
    "memory_notes",
    """SELECT CAST(p_partkey AS BIGINT) AS note, CASE WHEN p_size % 2 = 0 THEN concat('title: ', p_name, chr(10), 'size: ', CAST(p_size AS VARCHAR)) ELSE '' END AS header,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE concat('--- ', p_brand) END AS body FROM part""",
)
def memory_notes(spark, d):
    header = F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nsize: "), F.col("p_size").cast("string"), F.lit("\n---\n"), "p_brand")
    text = F.when(F.col("p_size") % 2 == 0, header).otherwise(F.concat(F.lit("--- "), "p_brand"))
    rows = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("note"), text.alias("text"))
    return notebook.read(rows).select("note", "header", "body")


@register(
    "call_arg_hashes",
    """SELECT event_type AS tool, count(DISTINCT json_extract_string(props, '$.k')) AS distinct_args FROM events GROUP BY 1""",
)
def call_arg_hashes(spark, d):
    """Arguments count once whatever routing keys come with them."""
    args = F.concat(F.regexp_replace("args", r"\}$", ""), F.lit(', "session_id": "s'), F.col("call_id").cast("string"), F.lit('"}'))
    return A.tool_calls(spark, d).groupBy("tool").agg(F.countDistinct(telemetry.arg_hash(args)).alias("distinct_args"))


@register(
    "file_confidence",
    f"""WITH {FA} SELECT id, CASE WHEN ext = 'ts' AND starts_with(relative_path, 'web/src/dto/') THEN 'needs_structural_evidence' ELSE 'high' END AS tier,
  CAST(CASE WHEN p_size % 6 IN (0, 5) THEN 0.55 ELSE 1.0 END AS DOUBLE) AS penalty FROM fa""",
)
def file_confidence(spark, d):
    # the folder alone says what shape a file has
    near = F.concat(F.regexp_replace("relative_path", "/[^/]*/[^/]*$", "/x."), T.extension(F.col("relative_path")))
    rows = A.sources(spark, d).select("id", T.file_tier(near).alias("tier"))
    other = A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), T.markup_penalty(F.expr(_ROLES), F.lit("query")).alias("penalty"))
    return rows.join(other, "id")


@register(
    "noise_callee_filter",
    """SELECT CAST(p_partkey AS BIGINT) AS id, p_size % 5 = 0 OR p_size % 5 = 2 OR (p_size % 5 = 1 AND p_type <> 'MEDIUM') AS noise FROM part""",
)
def noise_callee_filter(spark, d):
    name = F.expr("CASE p_size % 5 WHEN 0 THEN 'unwrap' WHEN 1 THEN 'make' WHEN 2 THEN 'len' WHEN 3 THEN replace(p_name, ' ', '_') ELSE 'parse_all' END")
    name = F.when((F.col("p_type") == "MEDIUM") & (F.col("p_size") % 5 == 1), "new").otherwise(name)
    lang = F.when(F.col("p_type") == "MEDIUM", "rs").otherwise("py")
    return A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), T.is_noise_callee(name, lang).alias("noise"))


@register(
    "scan_symbols_in_files",
    f"WITH {SY} SELECT file_path, line, id, name FROM sy WHERE file_path IN (SELECT DISTINCT file_path FROM sy WHERE line = 7)",
)
def scan_symbols_in_files(spark, d):
    s = A.symbols(spark, d)
    return lookup.symbols_in(s, s.where("line = 7").select("file_path")).select("file_path", "line", "id", "name")


@register(
    "find_symbol_substring_in_path",
    f"WITH {SY} SELECT id, name, file_path FROM sy WHERE name ILIKE '%ring%' AND starts_with(file_path, 'src/brand2/') ORDER BY length(name), name, id LIMIT 50",
)
def find_symbol_substring_in_path(spark, d):
    return lookup.substring_with_path(A.symbols(spark, d), "ring", "src/brand2", 50).select("id", "name", "file_path")


# --- parsed sources --------------------------------------------------------------------------------


def _parsed(spark, d):
    return code.parse_python(A.sources(spark, d).where("relative_path LIKE '%.py'"))


PR = f"pr AS ({A.PROGRAM_FACTS_SQL})"


@register(
    "code_words",
    f"""WITH {PR} SELECT id, CAST(unnest(CASE ext WHEN 'rs' THEN [4, 10] WHEN 'ts' THEN [3, 4, 8] WHEN 'go' THEN [2, 7] WHEN 'java' THEN [3, 6] WHEN 'kt' THEN [2, 5] ELSE [2, 4] END) AS BIGINT) AS line_no,
  CAST(1 AS BIGINT) AS matches FROM pr WHERE n = 'small_ring'""",
)
def code_words(spark, d):
    """Occurrences of a name in programs that have it in strings and comments too."""
    return lookup.word_matches(A.programs(spark, d), "small_ring")


@register(
    "rename_in_code",
    f"""WITH {PR}, r AS (SELECT id, unnest(CASE ext WHEN 'rs' THEN [4, 10] WHEN 'ts' THEN [3, 4, 8] WHEN 'go' THEN [2, 7] WHEN 'java' THEN [3, 6] WHEN 'kt' THEN [2, 5] ELSE [2, 4] END) AS line_no,
  unnest(CASE ext WHEN 'rs' THEN ['    pub fn big_ring(&self, x: &''a str) -> char {{', '    big_ring(r#"a " small_ring("#);'] WHEN 'ts' THEN ['  big_ring(x: string): string {{', concat('    const s = `small_ring ${{big_ring(x)}}`; if (helper_', k, '("//")) {{ this.#go(); }}'), 'const one = (x) => big_ring(x); /* small_ring( */']
    WHEN 'go' THEN ['func big_ring(x string) string {{', '	return big_ring(x) // small_ring(']
    WHEN 'java' THEN ['    int big_ring(String s) throws E {{', '        return big_ring(s); // small_ring()'] WHEN 'kt' THEN ['fun big_ring(x: Int): Int {{', '    return big_ring(x) // "small_ring"']
    ELSE ['def big_ring(x, y):', '    return big_ring(x // y)  # small_ring'] END) AS after FROM pr WHERE n = 'small_ring')
SELECT id, CAST(line_no AS BIGINT) AS line_no, after FROM r""",
)
def rename_in_code(spark, d):
    return edits.rename(A.programs(spark, d), "small_ring", "big_ring").select("id", "line_no", "after")


def _programs(spark, d):
    return code.parse_sources(A.programs(spark, d).where("relative_path NOT LIKE '%.py'"))


@register(
    "parse_symbols_by_language",
    f"""WITH {PR}, s AS (SELECT relative_path AS file_path, unnest(CASE ext
  WHEN 'rs' THEN [{{'n': concat('Ring_', k), 'k': 'class', 'p': concat('Ring_', k), 'l': 2, 'e': 2}}, {{'n': n, 'k': 'method', 'p': concat('Ring_', k, '/', n), 'l': 4, 'e': 7}}, {{'n': concat('free_', k), 'k': 'function', 'p': concat('free_', k), 'l': 9, 'e': 11}}]
  WHEN 'ts' THEN [{{'n': concat('Ring_', k), 'k': 'class', 'p': concat('Ring_', k), 'l': 2, 'e': 6}}, {{'n': n, 'k': 'method', 'p': concat('Ring_', k, '/', n), 'l': 3, 'e': 5}}, {{'n': 'Shape', 'k': 'interface', 'p': 'Shape', 'l': 7, 'e': 7}}, {{'n': 'one', 'k': 'function', 'p': 'one', 'l': 8, 'e': 8}}]
  WHEN 'go' THEN [{{'n': n, 'k': 'function', 'p': n, 'l': 2, 'e': 8}}, {{'n': concat('Ring_', k), 'k': 'class', 'p': concat('Ring_', k), 'l': 9, 'e': 9}}, {{'n': 'Run', 'k': 'method', 'p': 'Run', 'l': 10, 'e': 10}}]
  WHEN 'java' THEN [{{'n': concat('Ring_', k), 'k': 'class', 'p': concat('Ring_', k), 'l': 2, 'e': 8}}, {{'n': n, 'k': 'method', 'p': concat('Ring_', k, '/', n), 'l': 3, 'e': 7}}]
  ELSE [{{'n': n, 'k': 'function', 'p': n, 'l': 2, 'e': 6}}, {{'n': concat('Ring_', k), 'k': 'class', 'p': concat('Ring_', k), 'l': 7, 'e': 9}}, {{'n': 'go', 'k': 'method', 'p': concat('Ring_', k, '/go'), 'l': 8, 'e': 8}}] END) AS x FROM pr WHERE ext <> 'py')
SELECT file_path, x.n AS name, x.k AS kind, x.p AS name_path, CAST(x.l AS BIGINT) AS line, CAST(x.e AS BIGINT) AS end_line FROM s""",
)
def parse_symbols_by_language(spark, d):
    return _programs(spark, d).where("row = 'symbol'").select("file_path", "name", "kind", "name_path", "line", "end_line")


@register(
    "parse_calls_by_language",
    f"""WITH {PR}, s AS (SELECT relative_path AS file_path, unnest(CASE ext
  WHEN 'rs' THEN [{{'c': concat('Ring_', k, '/', n), 'n': concat('helper_', k), 'l': 6}}, {{'c': concat('Ring_', k, '/', n), 'n': 'other', 'l': 6}}, {{'c': concat('free_', k), 'n': n, 'l': 10}}]
  WHEN 'ts' THEN [{{'c': concat('Ring_', k, '/', n), 'n': n, 'l': 4}}, {{'c': concat('Ring_', k, '/', n), 'n': concat('helper_', k), 'l': 4}}, {{'c': concat('Ring_', k, '/', n), 'n': 'go', 'l': 4}}, {{'c': 'one', 'n': n, 'l': 8}}]
  WHEN 'go' THEN [{{'c': n, 'n': concat('helper_', k), 'l': 6}}, {{'c': n, 'n': n, 'l': 7}}, {{'c': 'Run', 'n': 'check', 'l': 10}}]
  WHEN 'java' THEN [{{'c': concat('Ring_', k, '/', n), 'n': concat('helper_', k), 'l': 5}}, {{'c': concat('Ring_', k, '/', n), 'n': n, 'l': 6}}]
  ELSE [{{'c': n, 'n': concat('helper_', k), 'l': 4}}, {{'c': n, 'n': n, 'l': 5}}, {{'c': concat('Ring_', k, '/go'), 'n': 'check', 'l': 8}}] END) AS x FROM pr WHERE ext <> 'py')
SELECT file_path, x.c AS caller, x.n AS callee, CAST(x.l AS BIGINT) AS line FROM s""",
)
def parse_calls_by_language(spark, d):
    return _programs(spark, d).where("row = 'call'").select("file_path", F.col("name_path").alias("caller"), F.col("name").alias("callee"), "line")


_PY = "py AS (SELECT * FROM fa WHERE ext = 'py')"
_NAMES = "concat(CASE WHEN p_partkey % 7 = 0 THEN 'test_' ELSE 'run_' END, CAST(p_size AS VARCHAR))"


@register(
    "parse_symbols",
    f"""WITH {FA}, {_PY} SELECT relative_path AS file_path, {_NAMES} AS name, 'function' AS kind, CAST(6 AS BIGINT) AS line, CAST(7 AS BIGINT) AS end_line FROM py
UNION ALL SELECT relative_path, 'C', 'class', 10, 10 FROM py UNION ALL SELECT relative_path, n, 'function', 9, 9 FROM py WHERE p_partkey % 3 = 0""",
)
def parse_symbols(spark, d):
    return _parsed(spark, d).where("row = 'symbol'").select("file_path", "name", "kind", "line", "end_line")


@register(
    "parse_calls_and_imports",
    f"""WITH {FA}, {_PY} SELECT relative_path AS file_path, 'call' AS row, concat('helper_', CAST(p_size AS VARCHAR)) AS name, n AS name_path FROM py WHERE p_partkey % 3 = 0
UNION ALL SELECT relative_path, 'import', unnest(['os', concat(b, '.', n), concat('.', n, '_', CAST(id AS VARCHAR)), '..up']), '' FROM py""",
)
def parse_calls_and_imports(spark, d):
    return _parsed(spark, d).where("row <> 'symbol'").select("file_path", "row", "name", "name_path")


@register(
    "scoped_references",
    f"""WITH {FA}, {_PY}, r AS (SELECT relative_path AS file_path, unnest(CASE WHEN p_partkey % 3 = 0 THEN [{{'name': n, 'line': 9, 'kind': 'definition', 'scope': ''}}, {{'name': 'x', 'line': 9, 'kind': 'definition', 'scope': n}},
    {{'name': concat('helper_', CAST(p_size AS VARCHAR)), 'line': 9, 'kind': 'read', 'scope': n}}, {{'name': 'x', 'line': 9, 'kind': 'read', 'scope': n}}] ELSE [{{'name': 'z', 'line': 9, 'kind': 'write', 'scope': ''}}] END) AS r FROM py
  UNION ALL SELECT relative_path, unnest([{{'name': 'os', 'line': 1, 'kind': 'import', 'scope': ''}}, {{'name': 'm', 'line': 1, 'kind': 'import', 'scope': ''}}, {{'name': 'x', 'line': 2, 'kind': 'import', 'scope': ''}},
    {{'name': 'y', 'line': 3, 'kind': 'import', 'scope': ''}}, {{'name': {_NAMES}, 'line': 6, 'kind': 'definition', 'scope': ''}}, {{'name': 'x', 'line': 6, 'kind': 'definition', 'scope': {_NAMES}}}, {{'name': 'C', 'line': 10, 'kind': 'definition', 'scope': ''}}]) FROM py
  UNION ALL SELECT relative_path, {{'name': 'cached', 'line': 5, 'kind': 'read', 'scope': {_NAMES}}} FROM py WHERE p_partkey % 5 = 0
  UNION ALL SELECT relative_path, {{'name': unnest(['a', 'b', 'c']), 'line': 7, 'kind': 'read', 'scope': {_NAMES}}} FROM (SELECT *, unnest(range(CAST(p_size % 4 AS BIGINT))) FROM py))
SELECT file_path, r.name AS name, CAST(r.line AS BIGINT) AS line, r.kind AS kind, r.scope AS scope FROM r""",
)
def scoped_references(spark, d):
    return code.scoped_references(A.sources(spark, d).where("relative_path LIKE '%.py'"))


@register(
    "extract_plan",
    f"""WITH {FA} SELECT id, true AS valid, CASE ext WHEN 'py' THEN concat('def part():', chr(10), '    ', l, chr(10)) WHEN 'ts' THEN concat('function part() {{', chr(10), '    ', l, chr(10), '}}', chr(10))
  WHEN 'rs' THEN concat('fn part() {{', chr(10), '    ', l, chr(10), '}}', chr(10)) ELSE concat('func part() {{', chr(10), '    ', l, chr(10), '}}', chr(10)) END AS definition,
  CASE WHEN ext IN ('py', 'go') THEN concat(i, 'part()') ELSE concat(i, 'part();') END AS call
FROM (SELECT *, '    ' AS i, CASE WHEN ext = 'py' THEN concat('pass; ', repeat('a and b or c; ', CAST(p_size % 4 AS INT))) ELSE repeat('if a && b {{}} ', CAST(p_size % 4 AS INT)) END AS l FROM fa WHERE ext = 'py' OR p_size % 4 > 0)""",
)
def extract_plan(spark, d):
    """The body of each file's function; Python's is never blank, others only where there is a branch."""
    f = A.sources(spark, d).where(F.split("content", "\n")[6].rlike(r"\S"))
    return edits.extract(f, f.select("id", F.lit(7).alias("start"), F.lit(7).alias("stop"), F.lit("part").alias("name")))


@register(
    "inline_plan",
    f"""WITH {FA} SELECT id, CAST(9 AS BIGINT) AS line_no, 'remove' AS action, '' AS after FROM fa WHERE p_partkey % 3 = 0 AND ext <> 'go' AND NOT starts_with(relative_path, 'tests/')
UNION ALL SELECT id, 11, 'replace', concat('y = helper_', CAST(p_size AS VARCHAR), '(2)') FROM fa WHERE p_partkey % 3 = 0 AND ext <> 'go' AND NOT starts_with(relative_path, 'tests/')""",
)
def inline_plan(spark, d):
    """Each file calls its own wrapper once more, at its end."""
    f = A.sources(spark, d)
    name = F.regexp_extract("relative_path", r"([a-z_]+)_[0-9]+\.[a-z]+$", 1)
    more = f.withColumn("content", F.concat("content", F.lit("\ny = "), name, F.lit("(2)")))
    return edits.inline(more, lookup.redundant_wrappers(f))


@register(
    "change_signature_plan",
    f"""WITH {FA} SELECT id, CAST(9 AS BIGINT) AS line_no, 'replace' AS action, CASE ext WHEN 'rs' THEN concat('pub fn small_ring(a, b) -> i32 {{ helper_', CAST(p_size AS VARCHAR), '(x) }}')
  WHEN 'ts' THEN concat('function small_ring(a, b) {{ return helper_', CAST(p_size AS VARCHAR), '(x); }}') ELSE concat('def small_ring(a, b): return helper_', CAST(p_size AS VARCHAR), '(x)') END AS after
FROM fa WHERE n = 'small_ring' AND p_partkey % 3 = 0 AND ext <> 'go'""",
)
def change_signature_plan(spark, d):
    return edits.change_signature(A.sources(spark, d), "small_ring", "a, b")


@register("jsonl_sink", f"WITH {SY} SELECT * FROM sy")
def jsonl_sink(spark, d):
    """Symbols written as JSON lines and read back."""
    rows, folder = A.symbols(spark, d), storage.new_folder(spark, "jsonl")
    code.write_jsonl(rows, folder)
    return code.read_jsonl(spark, folder, rows.schema)


@register(
    "symbol_stream",
    f"WITH {SY}, r AS (SELECT *, row_number() OVER (ORDER BY file_path, line, id) AS place FROM sy) SELECT file_path, line, id, place FROM r",
)
def symbol_stream(spark, d):
    """All symbols in the order of file and position, numbered; sorted by ranges."""
    return lookup.numbered(A.symbols(spark, d).select("file_path", "line", "id"), "file_path", "line", "id")


@register(
    "test_symbols",
    f"""WITH {FA} SELECT id, p_partkey % 7 = 0 AND ext <> 'ts' AS is_test FROM fa""",
)
def test_symbols(spark, d):
    """The function in line 6 of each file, by its mark or its name."""
    rows = F.split("content", "\n")
    start = F.octet_length(F.array_join(F.slice(rows, 1, 5), "\n")) + 1
    name = F.regexp_extract(rows[5], r"(?:fn|def|func|function) (\w+)", 1)
    path = F.col("relative_path")
    test = T.is_test_symbol(path, name, F.concat(F.lit("m::"), name), F.lit("function"), F.col("content"), start)
    return A.sources(spark, d).select("id", test.alias("is_test"))


@register(
    "dominant_language",
    f"""WITH {FA}, n AS (SELECT split_part(relative_path, '/', 1) AS root, CASE ext WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' ELSE 'go' END AS language, count(*) AS files FROM fa GROUP BY 1, 2)
SELECT root, language, files FROM n QUALIFY row_number() OVER (PARTITION BY root ORDER BY files DESC, language) = 1""",
)
def dominant_language(spark, d):
    return reports.dominant_language(A.sources(spark, d))
