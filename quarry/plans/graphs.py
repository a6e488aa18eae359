"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry.functions import text as T
from quarry.operators import graph, lookup, reports, types, vector
from quarry.registry import register

E = f"e AS ({A.EDGES_SQL})"
N = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def pagerank_steps(rounds: int = graph.ROUNDS) -> str:
    """Common table expressions r0 to r20 over e (src, dst) and n (node)."""
    steps = ["d AS (SELECT src, count(*) AS out FROM e GROUP BY src)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS score FROM n)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(sum(r.score / d.out), 0) AS score "
            f"FROM n LEFT JOIN e ON e.dst = n.node LEFT JOIN r{i - 1} r ON r.node = e.src LEFT JOIN d ON d.src = e.src GROUP BY n.node)"
        )
    return ", ".join(steps)


def _pagerank_sql() -> str:
    return f"WITH {E}, {N}, " + pagerank_steps()


@register("pagerank", _pagerank_sql() + f" SELECT node, round(score, 9) AS score FROM r{graph.ROUNDS}")
def pagerank(spark, d):
    return graph.pagerank(A.edges(spark, d)).select("node", F.round("score", 9).alias("score"))


@register(
    "symbol_importance",
    _pagerank_sql()
    + f" SELECT node, printf('%.4f', score) AS score FROM r{graph.ROUNDS} ORDER BY round(score, 9) DESC, node LIMIT 10",
)
def symbol_importance(spark, d):
    top = graph.pagerank(A.edges(spark, d)).orderBy(F.round("score", 9).desc(), "node").limit(10)
    return top.select("node", F.format_string("%.4f", "score").alias("score"))


@register(
    "pagerank_semantic",
    _pagerank_sql()
    + f" SELECT node, round(score * least(1 + (node % 100) / 100.0, 5), 9) AS score FROM r{graph.ROUNDS}",
)
def pagerank_semantic(spark, d):
    sem = (F.col("node") % 100) / 100.0
    return graph.pagerank(A.edges(spark, d)).select(
        "node", F.round(F.col("score") * F.least(1 + sem, F.lit(5.0)), 9).alias("score")
    )


@register(
    "import_graph",
    f"""WITH {E}, n AS (SELECT CAST(p_partkey AS BIGINT) AS node FROM part WHERE p_size > 5),
o AS (SELECT src AS node, count(*) AS c FROM e GROUP BY src), i AS (SELECT dst AS node, count(*) AS c FROM e GROUP BY dst)
SELECT n.node, coalesce(o.c, 0) AS n_imports, coalesce(i.c, 0) AS n_imported_by FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)""",
)
def import_graph(spark, d):
    indexed = A.table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("node"))
    return graph.adjacency(A.edges(spark, d), indexed)


@register("importers_of", f"WITH {E} SELECT dst, src FROM e WHERE dst IN (1, 2, 3, 5, 8)")
def importers_of(spark, d):
    return A.edges(spark, d).where(F.col("dst").isin(1, 2, 3, 5, 8)).select("dst", "src")


ROOTS = (1, 7, 42)
_REACH = f"""WITH RECURSIVE {E}, b(root, node, depth) AS (
  SELECT CAST(x AS BIGINT), CAST(x AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT unnest([1, 7, 42]) AS x)
  UNION SELECT root, e.{{to}}, depth + 1 FROM b JOIN e ON e.{{at}} = b.node WHERE depth < {{max}})
SELECT root, node, min(depth) AS depth FROM b GROUP BY root, node HAVING min(depth) > 0"""


def _roots(spark):
    return spark.createDataFrame([(x,) for x in ROOTS], "root long")


@register("blast_radius", _REACH.format(to="src", at="dst", max=3))
def blast_radius(spark, d):
    return graph.reach(A.edges(spark, d), _roots(spark), 3)


@register("dependency_reach", _REACH.format(to="dst", at="src", max=2))
def dependency_reach(spark, d):
    return graph.reach(graph.flip(A.edges(spark, d)), _roots(spark), 2)


_REACH_ONLY = _REACH.format(to="src", at="dst", max=2)


@register(
    "impact_analysis",
    f"""SELECT x.root, count(*) AS affected, count(*) FILTER (depth = 1) AS direct, count(DISTINCT p_brand) AS modules
FROM ({_REACH_ONLY}) x JOIN part ON p_partkey = x.node GROUP BY x.root""",
)
def impact_analysis(spark, d):
    r = graph.reach(A.edges(spark, d), _roots(spark), 2)
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_brand")
    return r.join(p, "node").groupBy("root").agg(
        F.count(F.lit(1)).alias("affected"),
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.countDistinct("p_brand").alias("modules"),
    )


@register(
    "directory_impact",
    f"""SELECT node, min(depth) AS depth, string_agg(CAST(root AS VARCHAR), ',' ORDER BY root) AS sources FROM ({_REACH_ONLY}) GROUP BY node""",
)
def directory_impact(spark, d):
    r = graph.reach(A.edges(spark, d), _roots(spark), 2)
    listed = F.array_join(F.sort_array(F.collect_set("root")).cast("array<string>"), ",")  # at most the roots asked for
    return r.groupBy("node").agg(F.min("depth").alias("depth"), listed.alias("sources"))


_CYCLES = """t(a, b) AS (SELECT src, dst FROM {e} UNION SELECT t.a, e.dst FROM t JOIN {e} e ON e.src = t.b),
m AS (SELECT a AS node, least(a, min(b)) AS component FROM (SELECT x.a, x.b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) GROUP BY a)"""


@register("import_cycles", f"WITH RECURSIVE e AS ({A.PACKAGE_EDGES_SQL}), {_CYCLES.format(e='e')} SELECT node, component FROM m")
def import_cycles(spark, d):
    return graph.cycles(A.package_edges(spark, d))


@register("import_cycles_project", f"WITH RECURSIVE e AS ({A.EDGES_SQL}), {_CYCLES.format(e='e')} SELECT node, component FROM m")
def import_cycles_project(spark, d):
    return graph.cycles(A.edges(spark, d))


@register(
    "change_coupling",
    f"""WITH c AS ({A.COMMITS_SQL}), t AS (SELECT file, count(*) AS total FROM c GROUP BY file),
p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS co_changes FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT file_a, file_b, co_changes, x.total AS total_a, y.total AS total_b, round(co_changes / greatest(x.total, y.total), 6) AS strength
FROM p JOIN t x ON x.file = file_a JOIN t y ON y.file = file_b""",
)
def change_coupling(spark, d):
    return graph.coupling(A.commits(spark, d)).select(
        "file_a", "file_b", "co_changes", "total_a", "total_b", F.round("strength", 6).alias("strength")
    )


@register(
    "dead_files",
    f"""WITH e AS ({A.PACKAGE_EDGES_SQL}), f AS (SELECT CAST(p_partkey AS BIGINT) AS node, concat(lower(p_brand), '/', CASE WHEN p_size = 1 THEN 'main.rs' WHEN p_size = 2 THEN 'a.toml' ELSE concat(replace(p_name, ' ', '_'), '.rs') END) AS path FROM part)
SELECT node, path FROM f WHERE node NOT IN (SELECT dst FROM e) AND NOT ends_with(path, '/main.rs') AND NOT ends_with(path, '.toml')""",
)
def dead_files(spark, d):
    p = A.table(spark, d, "part")
    path = F.concat(
        F.lower("p_brand"),
        F.lit("/"),
        F.when(F.col("p_size") == 1, "main.rs").when(F.col("p_size") == 2, "a.toml").otherwise(
            F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".rs"))
        ),
    )
    return graph.dead_files(A.package_edges(spark, d), p.select(F.col("p_partkey").alias("node"), path.alias("path")))


_MOD = "m AS (SELECT CAST(p_partkey AS BIGINT) AS node, lower(replace(p_brand, '#', '')) AS module FROM part)"
_ROLL = f"""WITH {E}, {_MOD}, r AS (SELECT a.module AS from_module, b.module AS to_module, count(*) AS file_pair_count
FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.module <> b.module GROUP BY 1, 2)"""


def _rollup(spark, d):
    m = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("node"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("module")
    )
    return graph.module_edges(A.edges(spark, d), m)


@register("workspace_modules", f"{_ROLL} SELECT * FROM r")
def workspace_modules(spark, d):
    return _rollup(spark, d)


@register(
    "mermaid_module_graph",
    f"""{_ROLL}, t AS (SELECT * FROM r ORDER BY file_pair_count DESC, from_module, to_module LIMIT 20)
SELECT concat('graph LR', chr(10), string_agg(concat('  ', from_module, ' -->|', CAST(file_pair_count AS VARCHAR), '| ', to_module), chr(10) ORDER BY file_pair_count DESC, concat('  ', from_module, ' -->|', CAST(file_pair_count AS VARCHAR), '| ', to_module))) AS diagram FROM t""",
)
def mermaid_module_graph(spark, d):
    return graph.mermaid(_rollup(spark, d))


@register(
    "type_hierarchy",
    """WITH RECURSIVE s AS (SELECT p_partkey AS name, p_partkey // 3 AS supertype FROM part WHERE p_partkey > 0),
t(root, node, depth) AS (SELECT CAST(x AS BIGINT), CAST(x AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT unnest([1, 5]) AS x)
  UNION ALL SELECT root, CAST(name AS BIGINT), depth + 1 FROM t JOIN s ON supertype = node WHERE depth < 50)
SELECT root, node, depth FROM t WHERE depth > 0""",
)
def type_hierarchy(spark, d):
    s = A.table(spark, d, "part").where("p_partkey > 0").select(
        F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / 3).cast("long").alias("supertype")
    )
    return types.hierarchy(s, spark.createDataFrame([(1,), (5,)], "root long"))


@register(
    "architecture_overview",
    f"""WITH sy AS ({A.SYMBOLS_SQL}), {E}, s AS (SELECT regexp_extract(file_path, '^(.*/)', 1) AS dir, count(DISTINCT file_path) AS files, count(*) AS symbols FROM sy GROUP BY 1),
i AS (SELECT regexp_extract(b.file_path, '^(.*/)', 1) AS dir, count(*) AS fan_in FROM e JOIN sy b ON b.id = dst GROUP BY 1)
SELECT s.dir, files, symbols, coalesce(fan_in, 0) AS fan_in FROM s LEFT JOIN i USING (dir)""",
)
def architecture_overview(spark, d):
    s = A.symbols(spark, d)
    into = A.edges(spark, d).join(s.select(F.col("id").alias("dst"), "file_path"), "dst")
    fan = into.groupBy(T.directory(F.col("file_path")).alias("dir")).agg(F.count(F.lit(1)).alias("fan_in"))
    zero = F.lit(0).cast("long")
    return lookup.dir_stats(s).join(fan, "dir", "left").select("dir", "files", "symbols", F.coalesce("fan_in", zero).alias("fan_in"))


_ROOTS_SQL = "ro AS (SELECT CAST(x AS BIGINT) AS root FROM (SELECT unnest([1, 7, 42]) AS x))"


@register(
    "direct_importers",
    f"""WITH {E}, {_ROOTS_SQL}, r AS (SELECT root, src AS importer, row_number() OVER (PARTITION BY root ORDER BY src) AS n, count(*) OVER (PARTITION BY root) AS c FROM ro JOIN e ON e.dst = root)
SELECT root, importer, c > 20 AS limit_hit FROM r WHERE n <= 20""",
)
def direct_importers(spark, d):
    return reports.importers(A.edges(spark, d), _roots(spark))


@register(
    "impact_report",
    f"""SELECT x.root, x.node AS file, x.depth, p_size % 4 + 1 AS symbol_count FROM ({_REACH.format(to="src", at="dst", max=2)}) x JOIN part ON p_partkey = x.node""",
)
def impact_report(spark, d):
    p = A.table(spark, d, "part")
    symbols = p.select(F.col("p_partkey").alias("file"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 4)).alias("n"))
    return reports.impact(A.edges(spark, d), symbols, _roots(spark), 2)


_MODULE_EDGES = f"SELECT DISTINCT src, dst FROM ({A.PACKAGE_EDGES_SQL})"
_NORMS = "sqrt(list_sum(list_transform({0}, lambda z: CAST(z AS DOUBLE) * z)))"


@register(
    "boundary_report",
    f"""WITH RECURSIVE e AS ({_MODULE_EDGES}), {_CYCLES.format(e='e')},
b(node, depth) AS (SELECT CAST(69 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.src, depth + 1 FROM b JOIN e ON e.dst = b.node WHERE depth < 2),
c AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS f FROM lineitem), k AS (SELECT f, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 2),
p AS (SELECT y.f, count(*) AS together FROM c x JOIN c y ON x.o = y.o AND x.f = 69 AND y.f <> 69 JOIN k ON k.f = y.f GROUP BY 1),
v AS (SELECT vec_id AS id, embedding FROM embeddings),
s AS (SELECT b.id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])) / ({_NORMS.format("a.embedding")} * {_NORMS.format("b.embedding")}), 6) AS score
  FROM v a JOIN v b ON a.id = 69 AND b.id <> 69)
SELECT 'affected' AS section, CAST(node AS VARCHAR) AS item, CAST(min(depth) AS DOUBLE) AS value FROM b GROUP BY node HAVING min(depth) > 0
UNION ALL SELECT 'cycle', CAST(node AS VARCHAR), 1.0 FROM m WHERE component = (SELECT component FROM m WHERE node = 69) AND node <> 69
UNION ALL SELECT 'coupled', CAST(p.f AS VARCHAR), round(together / greatest(k.n, (SELECT n FROM k WHERE f = 69)), 6) FROM p JOIN k ON k.f = p.f WHERE together >= 2 AND together / greatest(k.n, (SELECT n FROM k WHERE f = 69)) >= 0.04
UNION ALL SELECT * FROM (SELECT 'alike', CAST(id AS VARCHAR), score FROM s WHERE score > 0.12 ORDER BY score DESC, id LIMIT 5)""",
)
def boundary_report(spark, d):
    root = spark.createDataFrame([(69,)], "root long")
    commits = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")).distinct()
    v = A.symbol_vectors(spark, d)
    one = v.where("id = 69").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    alike = vector.scores(v, one).select(F.col("query_id").alias("file"), F.col("id").alias("other"), "score")
    symbols = A.table(spark, d, "part").select(F.col("p_partkey").alias("file"))
    return reports.boundary(A.package_edges(spark, d).distinct(), symbols, commits, alike, root, 0.04, 2)  # orders are small commits


@register(
    "module_leaks",
    f"""WITH {E}, {_MOD}, x AS (SELECT a.module AS module, count(*) FILTER (b.module = a.module) AS inside, count(*) FILTER (b.module <> a.module) AS outgoing FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst GROUP BY 1)
SELECT module, inside, outgoing, round(outgoing / (inside + outgoing), 6) AS leak FROM x""",
)
def module_leaks(spark, d):
    m = A.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("module"))
    return graph.leaks(A.edges(spark, d), m)


@register(
    "diff_aware_references",
    f"""WITH {E}, ch AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_size % 4 = 0 THEN 'A' WHEN p_size % 4 = 1 THEN 'D' ELSE 'M' END AS status, p_size % 3 AS deletions FROM part WHERE p_size = 50)
SELECT node, CASE WHEN status = 'A' THEN 'additive' WHEN status = 'D' THEN 'breaking' WHEN deletions = 0 THEN 'additive' ELSE 'mixed' END AS change_kind, count(e.src) AS importers
FROM ch LEFT JOIN e ON e.dst = node GROUP BY 1, 2""",
)
def diff_aware_references(spark, d):
    p = A.table(spark, d, "part").where("p_size = 50")
    status = F.when(F.col("p_size") % 4 == 0, "A").when(F.col("p_size") % 4 == 1, "D").otherwise("M")
    ch = p.select(F.col("p_partkey").alias("dst"), T.change_kind(status, F.col("p_size") % 3).alias("change_kind"))
    return ch.join(A.edges(spark, d), "dst", "left").groupBy(F.col("dst").alias("node"), "change_kind").agg(
        F.count("src").alias("importers")
    )


# --- compositions ----------------------------------------------------------------------------------


def _onboard_sql() -> str:
    steps = _pagerank_sql().replace(f"WITH {E}, {N}", f"WITH RECURSIVE sy AS ({A.SYMBOLS_SQL}), e AS ({A.PACKAGE_EDGES_SQL}), {N}", 1)
    return steps + f""", t(a, b) AS (SELECT src, dst FROM e UNION SELECT t.a, e.dst FROM t JOIN e ON e.src = t.b),
cy AS (SELECT a AS node, least(a, min(b)) AS component FROM (SELECT x.a, x.b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) GROUP BY a)
SELECT * FROM (SELECT 'directory' AS section, regexp_extract(file_path, '^(.*/)', 1) AS item, CAST(count(*) AS VARCHAR) AS value FROM sy GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'important', CAST(node AS VARCHAR), printf('%.4f', score) FROM r{graph.ROUNDS} ORDER BY round(score, 9) DESC, node LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'cycle', CAST(component AS VARCHAR), CAST(count(*) AS VARCHAR) FROM cy GROUP BY component ORDER BY count(*) DESC, component LIMIT 10)"""


@register("onboard_project", _onboard_sql())
def onboard_project(spark, d):
    return reports.onboard(A.symbols(spark, d), A.package_edges(spark, d))


@register(
    "analysis_artifacts",
    "SELECT event_id AS id, value FROM events WHERE epoch_us(ts) // 1000 > 1705000000000 - 21600000 AND event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50",
)
def analysis_artifacts(spark, d):
    rows = A.tool_calls(spark, d).where("tool = 'purchase'").select(
        F.col("call_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created"), F.col("elapsed_ms").alias("value")
    )
    return reports.artifacts(rows, 1705000000000999, 21600000000, 50).select("id", "value")


_MANIFEST = "CASE p_size % 5 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'go.mod' ELSE 'notes.txt' END"


@register(
    "workspace_packages",
    """SELECT CASE WHEN p_partkey = 0 THEN '.' ELSE concat('p', CAST(p_partkey AS VARCHAR), '/') END AS root,
  CASE p_size % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python' ELSE 'go' END AS kind FROM part WHERE p_size % 5 <> 4""",
)
def workspace_packages(spark, d):
    folder = F.when(F.col("p_partkey") == 0, "").otherwise(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/")))
    return reports.workspaces(A.table(spark, d, "part").select(F.concat(folder, F.expr(_MANIFEST)).alias("relative_path")))
