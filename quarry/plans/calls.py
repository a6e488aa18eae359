"""Registered queries over the call graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import adapters as A
from quarry import storage
from quarry.operators import calls, edits, evaluation, graph, reports
from quarry.registry import register

_BASE = f"""code AS ({A.CODE_SQL}), edges AS ({A.EDGES_SQL}), calls AS ({A.CODE_CALLS_SQL}), imp AS ({A.CODE_IMPORTS_SQL}), bi AS ({A.BINDINGS_SQL}),
defs AS (SELECT DISTINCT name, file_path AS file FROM code)"""
_LANG = "CASE WHEN regexp_matches({0}, '\\.(rs|ts|py|go)$') THEN regexp_extract({0}, '\\.([a-z]+)$', 1) END"
_RESOLVE = f"""{_BASE},
own AS (SELECT *, CASE WHEN ends_with(caller_file, '.rs') THEN CASE WHEN qualifier = 'Self' THEN split_part(caller_path, '/', 1)
  WHEN starts_with(qualifier, 'store::') THEN replace(replace(qualifier, 'store::', ''), '<T>', '') END END AS owner FROM calls),
decl AS (SELECT name, split_part(name_path, '/', 1) AS owner, min(file_path) AS f, min(name_path) AS np FROM code WHERE kind = 'method' GROUP BY 1, 2 HAVING count(*) = 1),
vis AS (SELECT imp.src AS file, d.name, min(d.file) AS f FROM imp JOIN defs d ON d.file = imp.dst GROUP BY 1, 2),
suf AS (SELECT imp.src AS file, d.name, min(d.file) AS f FROM imp JOIN defs d ON d.file = concat('src/', imp.dst) OR d.file = imp.dst GROUP BY 1, 2),
pair AS (SELECT target AS file, callee_name AS name FROM own JOIN bi ON bi.file = caller_file AND bi.local IN (qualifier, callee_name) WHERE target IS NOT NULL
  UNION SELECT target, imported FROM bi WHERE target IS NOT NULL),
via AS (SELECT p.file, p.name, CASE WHEN o.file IS NOT NULL THEN o.target ELSE r.target END AS tf,
  CASE WHEN o.file IS NOT NULL THEN CASE o.imported WHEN '*' THEN p.name ELSE o.imported END ELSE p.name END AS tn
  FROM pair p LEFT JOIN bi o ON o.file = p.file AND o.local = p.name LEFT JOIN bi r ON r.file = p.file AND r.local = '*'),
rx AS (SELECT via.* FROM via JOIN defs ON defs.file = tf AND defs.name = tn),
sp AS (SELECT name, file_path AS file, {_LANG.format("file_path")} AS lang, count(*) OVER (PARTITION BY name, {_LANG.format("file_path")}) AS n FROM code),
site AS (SELECT DISTINCT caller_file, callee_name, qualifier, owner, {_LANG.format("caller_file")} AS lang FROM own),
ne AS (SELECT caller_file, callee_name, file AS f FROM (SELECT DISTINCT caller_file, callee_name, lang FROM site) s JOIN sp ON sp.name = callee_name AND sp.lang = s.lang
  QUALIFY row_number() OVER (PARTITION BY caller_file, callee_name ORDER BY
    CASE WHEN regexp_extract(file, '^(.*)/', 1) = regexp_extract(caller_file, '^(.*)/', 1) THEN 3 WHEN split_part(file, '/', 2) = split_part(caller_file, '/', 2) THEN 2 ELSE 1 END DESC, file) = 1),
st AS (SELECT s.caller_file, s.callee_name, s.qualifier, s.owner, CASE
    WHEN d.f IS NOT NULL THEN row(d.f, 'owner_qualified', 0.98, s.callee_name, d.np)
    WHEN s.owner IS NOT NULL THEN row(NULL, 'unresolved', 0.25, NULL, concat(s.owner, '/', s.callee_name))
    WHEN l.file IS NOT NULL AND sb.file IS NULL THEN row(s.caller_file, 'same_file', 0.90, s.callee_name, NULL)
    WHEN sd.file IS NOT NULL THEN row(sb.target, 'import_map', 0.95, s.callee_name, NULL)
    WHEN sx.tf IS NOT NULL THEN row(sx.tf, 'import_reexport_map', 0.93, sx.tn, NULL)
    WHEN bd.file IS NOT NULL THEN row(bb.target, 'import_map', 0.95, bb.imported, NULL)
    WHEN bx.tf IS NOT NULL THEN row(bx.tf, 'import_reexport_map', 0.93, bx.tn, NULL)
    WHEN vis.f IS NOT NULL THEN row(vis.f, 'import_map', 0.95, s.callee_name, NULL)
    WHEN suf.f IS NOT NULL THEN row(suf.f, 'import_suffix', 0.70, s.callee_name, NULL)
    WHEN u.file IS NOT NULL AND s.lang = 'ts' AND u.file <> s.caller_file THEN row(u.file, 'path_proximity', 0.50, s.callee_name, NULL)
    WHEN u.file IS NOT NULL THEN row(u.file, 'unique_name', 0.65, s.callee_name, NULL)
    WHEN ne.f IS NOT NULL THEN row(ne.f, 'path_proximity', 0.50, s.callee_name, NULL)
    ELSE row(NULL, 'unresolved', 0.25, NULL, NULL) END::STRUCT(f VARCHAR, s VARCHAR, c DOUBLE, n VARCHAR, d VARCHAR) AS r
  FROM site s LEFT JOIN decl d ON d.name = s.callee_name AND d.owner = s.owner
  LEFT JOIN defs l ON l.file = s.caller_file AND l.name = s.callee_name
  LEFT JOIN bi sb ON sb.file = s.caller_file AND sb.local = s.qualifier LEFT JOIN defs sd ON sd.file = sb.target AND sd.name = s.callee_name
  LEFT JOIN rx sx ON sx.file = sb.target AND sx.name = s.callee_name
  LEFT JOIN bi bb ON bb.file = s.caller_file AND bb.local = s.callee_name LEFT JOIN defs bd ON bd.file = bb.target AND bd.name = bb.imported
  LEFT JOIN rx bx ON bx.file = bb.target AND bx.name = bb.imported
  LEFT JOIN vis ON vis.file = s.caller_file AND vis.name = s.callee_name LEFT JOIN suf ON suf.file = s.caller_file AND suf.name = s.callee_name
  LEFT JOIN sp u ON u.name = s.callee_name AND u.lang = s.lang AND u.n = 1 LEFT JOIN ne ON ne.caller_file = s.caller_file AND ne.callee_name = s.callee_name),
res AS (SELECT o.call_id, o.caller_file, o.caller_name, o.callee_name, o.qualifier, r.f AS resolved_file, r.s AS strategy, r.c AS confidence, r.n AS canonical_name, r.d AS declaration
  FROM own o LEFT JOIN st ON st.caller_file = o.caller_file AND st.callee_name = o.callee_name AND st.qualifier IS NOT DISTINCT FROM o.qualifier AND st.owner IS NOT DISTINCT FROM o.owner)"""


def _calls(spark, d):
    return A.code_calls(A.edges(spark, d), A.code(spark, d))


def _resolved(spark, d, of=None, calling=None):
    """All calls with where they go; only those of a caller, or those that may mean a name."""
    c, k = A.code(spark, d), _calls(spark, d)
    if of is not None:
        k = k.where(F.col("caller_name") == of)
    if calling is not None:
        k = calls.naming(k, A.bindings(c), calling)
    # the calls are derived here, and read several times: for their files and names, and for the result
    return calls.resolve(storage.written(k, "calls"), c, A.code_imports(c), A.bindings(c))


@register(
    "call_resolution",
    f"WITH {_RESOLVE} SELECT call_id, resolved_file, strategy, confidence, canonical_name, declaration FROM res",
)
def call_resolution(spark, d):
    return _resolved(spark, d).select("call_id", "resolved_file", "strategy", "confidence", "canonical_name", "declaration")


@register(
    "external_call_filter",
    f"""WITH {_BASE}, x AS (SELECT call_id, coalesce(qualifier, callee_name) AS used, caller_file FROM calls)
SELECT call_id FROM x WHERE NOT EXISTS (SELECT 1 FROM bi WHERE bi.file = x.caller_file AND bi.local = used AND bi.external)
  AND NOT EXISTS (SELECT 1 FROM bi JOIN bi b2 ON b2.file = bi.target AND b2.local = bi.imported WHERE bi.file = x.caller_file AND bi.local = used AND b2.external)""",
)
def external_call_filter(spark, d):
    return calls.drop_external(_calls(spark, d), A.bindings(A.code(spark, d))).select("call_id")


_ONE = "(SELECT name FROM code WHERE id = 1)"


def _one(spark, d) -> str:
    """The name that callers and callees are asked for: that of the first part."""
    return A.code(spark, d).where("id = 1").first().name


@register(
    "get_callers",
    f"WITH {_RESOLVE} SELECT caller_file, caller_name, max(confidence) AS confidence FROM res WHERE callee_name = {_ONE} OR canonical_name = {_ONE} GROUP BY 1, 2",
)
def get_callers(spark, d):
    name = _one(spark, d)
    return calls.callers(_resolved(spark, d, calling=name), name)


@register(
    "get_callers_of_file",
    f"WITH {_RESOLVE} SELECT caller_file, caller_name, max(confidence) AS confidence FROM res WHERE canonical_name = {_ONE} AND resolved_file = (SELECT file_path FROM code WHERE id = 1) GROUP BY 1, 2",
)
def get_callers_of_file(spark, d):
    row = A.code(spark, d).where("id = 1").first()
    return calls.callers(_resolved(spark, d, calling=row.name), row.name, row.file_path)


@register(
    "get_callees",
    f"WITH {_RESOLVE} SELECT coalesce(canonical_name, callee_name) AS callee_name, resolved_file, max(confidence) AS confidence FROM res WHERE caller_name = {_ONE} GROUP BY 1, 2",
)
def get_callees(spark, d):
    name = _one(spark, d)
    return calls.callees(_resolved(spark, d, of=name), name)


@register(
    "cached_callers",
    f"WITH {_BASE} SELECT callee_name, count(*) AS calls, count(DISTINCT caller_file) AS files FROM calls GROUP BY callee_name",
)
def cached_callers(spark, d):
    return _calls(spark, d).groupBy("callee_name").agg(
        F.count(F.lit(1)).alias("calls"), F.countDistinct("caller_file").alias("files")
    )


@register(
    "call_trace",
    f"""WITH RECURSIVE {_BASE}, ce AS (SELECT DISTINCT caller_name AS src, callee_name AS dst FROM calls WHERE caller_name <> callee_name),
up(node, depth) AS (SELECT {_ONE}, CAST(0 AS BIGINT) UNION SELECT ce.src, depth + 1 FROM up JOIN ce ON ce.dst = up.node WHERE depth < 3),
down(node, depth) AS (SELECT {_ONE}, CAST(0 AS BIGINT) UNION SELECT ce.dst, depth + 1 FROM down JOIN ce ON ce.src = down.node WHERE depth < 3),
a AS (SELECT 'callers' AS side, node, min(depth) AS depth FROM up GROUP BY node HAVING min(depth) > 0
  UNION ALL SELECT 'callees', node, min(depth) FROM down GROUP BY node HAVING min(depth) > 0)
SELECT side, node, depth FROM a QUALIFY row_number() OVER (PARTITION BY side ORDER BY depth, node) <= 20""",
)
def call_trace(spark, d):
    e = _calls(spark, d).where("caller_name <> callee_name").select(F.col("caller_name").alias("src"), F.col("callee_name").alias("dst")).distinct()
    return graph.trace(e, _one(spark, d), 3, 20)


_RECENT = "l_shipdate >= TIMESTAMP '2001-07-01'"


def _recent(spark, d):
    """(name): what was called in the last months, a part by its full name."""
    lines = A.table(spark, d, "lineitem").where(_RECENT).select(F.col("l_partkey").alias("id"))
    return lines.join(A.code(spark, d), "id").select(_full().alias("callee_name"))


def _full():
    return F.concat("name", F.lit("_"), F.col("id").cast("string"))


def _named(spark, d):
    """Symbols with unique names; every tenth is a test or an entry point, every eleventh is decorated."""
    name = (
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("test_"), _full()))
        .when(F.col("id") % 101 == 7, "main")
        .otherwise(_full())
    )
    return A.code(spark, d).select("id", name.alias("name"), "kind", "file_path", (F.col("id") % 11 == 0).alias("decorated"))


_NAMED = f"""code AS ({A.CODE_SQL}), called AS (SELECT DISTINCT concat(code.name, '_', CAST(code.id AS VARCHAR)) AS name FROM lineitem JOIN code ON code.id = l_partkey WHERE {_RECENT}),
sy AS (SELECT id, CASE WHEN id % 10 = 0 THEN concat('test_', name, '_', CAST(id AS VARCHAR)) WHEN id % 101 = 7 THEN 'main' ELSE concat(name, '_', CAST(id AS VARCHAR)) END AS name, kind, file_path, id % 11 = 0 AS decorated FROM code),
im AS (SELECT DISTINCT b.file_path AS dst FROM code a JOIN code b ON b.id = a.id + 1 WHERE b.id % 6 <> 0),
dead_f AS (SELECT DISTINCT file_path FROM code WHERE file_path NOT IN (SELECT dst FROM im)),
dead AS (SELECT id, name, file_path FROM sy WHERE kind IN ('function', 'method') AND NOT decorated AND name NOT LIKE 'test%' AND name <> 'main'
  AND name NOT IN (SELECT name FROM called) AND file_path NOT IN (SELECT file_path FROM dead_f))"""


def _dead(spark, d):
    s = _named(spark, d)
    files = s.select("file_path").distinct().select(F.col("file_path").alias("node"), F.col("file_path").alias("path"))
    c = A.code(spark, d)
    lone = graph.dead_files(A.code_imports(c), files)
    return graph.dead_symbols(s, _recent(spark, d), lone.select(F.col("path").alias("file_path")))


@register("dead_symbols", f"WITH {_NAMED} SELECT id, name, file_path FROM dead")
def dead_symbols(spark, d):
    return _dead(spark, d).select("id", "name", "file_path")


@register(
    "dead_code",
    f"""WITH {_NAMED} SELECT CAST(1 AS BIGINT) AS pass, file_path AS file, NULL::VARCHAR AS symbol FROM dead_f
UNION ALL SELECT 2, file_path, name FROM dead""",
)
def dead_code(spark, d):
    s = _named(spark, d)
    return graph.dead_code(s, _recent(spark, d), A.code_imports(A.code(spark, d)))


@register(
    "dead_code_report",
    f"""WITH {_NAMED}, t AS (SELECT * FROM dead WHERE contains(file_path, 'brand1') ORDER BY file_path, name, id LIMIT 10),
v AS (SELECT id, file_path, m.embedding FROM sy JOIN embeddings m ON m.vec_id = sy.id),
l AS (SELECT sy.id, v.embedding FROM sy JOIN v ON v.id = sy.id WHERE sy.id NOT IN (SELECT id FROM dead)),
p AS (SELECT t.id, l.id AS live, round(list_sum(list_transform(list_zip(v.embedding, l.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2]))
  / (sqrt(list_sum(list_transform(v.embedding, lambda z: CAST(z AS DOUBLE) * z))) * sqrt(list_sum(list_transform(l.embedding, lambda z: CAST(z AS DOUBLE) * z)))), 6) AS score
  FROM t JOIN v ON v.id = t.id, l),
b AS (SELECT * FROM p WHERE score > 0.15 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, live) <= 3)
SELECT t.id, t.name, t.file_path, b.live, b.score FROM t LEFT JOIN b ON b.id = t.id""",
)
def dead_code_report(spark, d):
    v = A.vectors(spark, d).select("id", "embedding")
    return reports.dead_code_report(_dead(spark, d).select("id", "name", "file_path"), _named(spark, d), v, "brand1")


@register(
    "safe_delete",
    f"""WITH {_NAMED}, n AS (SELECT DISTINCT name FROM sy),
k AS (SELECT b.name, count(DISTINCT a.name) AS c FROM (SELECT DISTINCT * FROM (SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS src, l_partkey AS dst, l_shipdate FROM lineitem)) e
  JOIN sy a ON a.id = e.src JOIN sy b ON b.id = e.dst WHERE src <> dst AND {_RECENT} GROUP BY 1),
i AS (SELECT b.name, count(DISTINCT a.file_path) AS c FROM code x JOIN code y ON y.id = x.id + 1 JOIN sy b ON b.file_path = y.file_path JOIN sy a ON a.id = x.id WHERE y.id % 6 <> 0 AND a.file_path <> b.file_path GROUP BY 1)
SELECT name, coalesce(k.c, 0) AS callers, coalesce(i.c, 0) AS importers, coalesce(k.c, 0) + coalesce(i.c, 0) = 0 AS safe FROM n LEFT JOIN k USING (name) LEFT JOIN i USING (name)""",
)
def safe_delete(spark, d):
    s = _named(spark, d)
    lines = A.table(spark, d, "lineitem")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")  # an order's lines
    e = lines.select(F.lag("l_partkey").over(by).alias("src"), F.col("l_partkey").alias("dst"), "l_shipdate").where(_RECENT).where("src <> dst")
    c = e.join(s.select(F.col("id").alias("src"), F.col("name").alias("caller_name")), "src").join(
        s.select(F.col("id").alias("dst"), F.col("name").alias("callee_name")), "dst"
    )
    return edits.safe_delete(c, s, A.code_imports(A.code(spark, d)))


@register(
    "call_graph_f1",
    f"""WITH {_RESOLVE}, f AS (SELECT DISTINCT caller_name, callee_name, resolved_file FROM res WHERE confidence >= 0.9),
t AS (SELECT DISTINCT a.name AS caller_name, b.name AS callee_name, b.file_path AS resolved_file FROM edges JOIN code a ON a.id = src JOIN code b ON b.id = dst),
c AS (SELECT count(*) FILTER (f.caller_name IS NOT NULL AND t.caller_name IS NOT NULL) AS tp, count(*) FILTER (t.caller_name IS NULL) AS fp, count(*) FILTER (f.caller_name IS NULL) AS fn
  FROM f FULL JOIN t ON f.caller_name = t.caller_name AND f.callee_name = t.callee_name AND f.resolved_file = t.resolved_file),
r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM r""",
)
def call_graph_f1(spark, d):
    """What the sure stages resolve, against the parts that the lines name."""
    keys = ["caller_name", "callee_name", "resolved_file"]
    c = A.code(spark, d)
    a = c.select(F.col("id").alias("src"), F.col("name").alias("caller_name"))
    b = c.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"), F.col("file_path").alias("resolved_file"))
    truth = A.edges(spark, d).join(a, "src").join(b, "dst").select(*keys)
    return evaluation.prf(_resolved(spark, d).where("confidence >= 0.9").select(*keys), truth, keys)


@register(
    "missing_imports",
    f"""WITH {_BASE}, u AS (SELECT DISTINCT caller_file, callee_name AS name FROM calls),
o AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM code WHERE code.file_path = u.caller_file AND code.name = u.name)
  AND NOT EXISTS (SELECT 1 FROM imp JOIN code ON code.file_path = imp.dst WHERE imp.src = u.caller_file AND code.name = u.name) AND name NOT LIKE 'small%'),
c AS (SELECT DISTINCT o.caller_file, o.name, code.file_path AS candidate FROM o JOIN code ON code.name = o.name)
SELECT caller_file, name, candidate, CAST(CASE WHEN count(*) OVER (PARTITION BY caller_file, name) = 1 THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence
FROM c QUALIFY row_number() OVER (PARTITION BY caller_file, name ORDER BY candidate) <= 3""",
)
def missing_imports(spark, d):
    c = A.code(spark, d)
    builtin = c.where("name LIKE 'small%'").select("name").distinct()
    used = _calls(spark, d).select("caller_file", F.col("callee_name").alias("name"))
    return reports.missing_imports(used, c, A.code_imports(c), builtin)


@register(
    "move_symbol_plan",
    f"""WITH {_BASE}, h AS (SELECT DISTINCT file_path FROM code WHERE name = {_ONE})
SELECT file_path, 'remove' AS action FROM h UNION ALL SELECT 'src/rings.rs', 'insert' UNION ALL
SELECT DISTINCT src, 'update_import' FROM imp JOIN h ON h.file_path = imp.dst""",
)
def move_symbol_plan(spark, d):
    c = A.code(spark, d)
    return edits.move(c, A.code_imports(c), _one(spark, d), "src/rings.rs")


@register(
    "change_readiness",
    f"""WITH {_BASE}, ch AS (SELECT DISTINCT name FROM code WHERE line % 5 = 0), r AS (SELECT callee_name AS name, count(*) AS n FROM calls GROUP BY 1),
t AS (SELECT DISTINCT callee_name AS name FROM calls WHERE caller_file LIKE '%.py'), f AS (SELECT name, count(*) AS n FROM code GROUP BY 1),
x AS (SELECT ch.name AS subject, CASE WHEN f.n > 5 THEN 'blocked' WHEN f.n > 1 THEN 'caution' ELSE 'ready' END AS diagnostics,
  CASE WHEN coalesce(r.n, 0) > 100 THEN 'blocked' WHEN coalesce(r.n, 0) > 20 THEN 'caution' ELSE 'ready' END AS refs,
  CASE WHEN t.name IS NULL THEN 'caution' ELSE 'ready' END AS tests FROM ch LEFT JOIN r USING (name) LEFT JOIN t USING (name) LEFT JOIN f USING (name))
SELECT *, CASE WHEN 'blocked' IN (diagnostics, refs, tests) THEN 'blocked' WHEN 'caution' IN (diagnostics, refs, tests) THEN 'caution' ELSE 'ready' END AS mutation FROM x""",
)
def change_readiness(spark, d):
    c, k = A.code(spark, d), _calls(spark, d)
    name = F.col("callee_name").alias("subject")
    subject = F.col("name").alias("subject")
    return reports.readiness(c.where("line % 5 = 0").select(subject), c.select(subject), k.select(name), k.where("caller_file LIKE '%.py'").select(name))


@register(
    "unresolved_references",
    f"""WITH {_BASE}, u AS (SELECT callee_name AS name, count(*) AS uses FROM calls GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part GROUP BY 1),
d AS (SELECT name, count(*) AS n FROM code GROUP BY 1)
SELECT u.name, uses, coalesce(n, 0) AS exact, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM u LEFT JOIN d USING (name)""",
)
def unresolved_references(spark, d):
    foreign = A.table(spark, d, "part").select(F.col("p_type").alias("name"))  # names that no symbol has
    return reports.unresolved(_calls(spark, d).select(F.col("callee_name").alias("name")).unionAll(foreign), A.code(spark, d))


@register(
    "index_definitions",
    f"""WITH {_BASE}, o AS (SELECT DISTINCT caller_file AS file, CAST(length(callee_name) AS BIGINT) AS line, callee_name AS symbol FROM calls)
SELECT DISTINCT o.file, o.line, o.symbol, code.file_path AS def_file, code.line AS def_line FROM o JOIN code ON code.name = o.symbol""",
)
def index_definitions(spark, d):
    uses = _calls(spark, d).select(F.col("caller_file").alias("file"), F.col("callee_name").alias("symbol")).distinct()
    uses = uses.withColumn("line", F.length("symbol").cast("long"))
    occ = uses.withColumn("role", F.lit("reference")).unionByName(
        A.code(spark, d).select(F.col("file_path").alias("file"), F.col("name").alias("symbol"), "line", F.lit("definition").alias("role"))
    )
    return reports.occurrences_at(occ, uses.select("file", "line", "symbol"))


@register(
    "safe_rename_report",
    f"""WITH {_BASE}, r AS (SELECT DISTINCT name, CASE WHEN line < 25 THEN 'fresh_name' ELSE (SELECT name FROM code WHERE id = 2) END AS new_name FROM code WHERE brand = 'Brand#7' UNION SELECT 'ghost', 'fresh_name'),
d AS (SELECT name, count(DISTINCT file_path) AS n FROM code GROUP BY 1), c AS (SELECT callee_name AS name, count(*) AS n FROM calls GROUP BY 1),
k AS (SELECT r.name, r.new_name, count(DISTINCT a.file_path) AS n FROM r JOIN code a ON a.name = r.name JOIN code b ON b.name = r.new_name AND b.file_path = a.file_path GROUP BY 1, 2)
SELECT r.name, r.new_name, coalesce(d.n, 0) AS definitions, coalesce(c.n, 0) AS "references", coalesce(k.n, 0) AS collisions,
  CASE WHEN coalesce(k.n, 0) > 0 OR coalesce(d.n, 0) = 0 THEN 'blocked' WHEN d.n > 1 THEN 'caution' ELSE 'ready' END AS status
FROM r LEFT JOIN d USING (name) LEFT JOIN c USING (name) LEFT JOIN k ON k.name = r.name AND k.new_name = r.new_name""",
)
def safe_rename_report(spark, d):
    c = A.code(spark, d)
    second = c.where("id = 2").first().name
    asked = c.where("brand = 'Brand#7'").select("name", F.when(F.col("line") < 25, "fresh_name").otherwise(second).alias("new_name"))
    asked = asked.unionAll(spark.createDataFrame([("ghost", "fresh_name")], "name string, new_name string")).distinct()
    return reports.safe_rename(c, _calls(spark, d), asked)


@register(
    "refactor_safety_report",
    f"""WITH RECURSIVE {_BASE}, fi AS (SELECT DISTINCT file_path AS file FROM code WHERE brand = 'Brand#7'),
b(root, node, depth) AS (SELECT file, file, 0 FROM fi UNION SELECT root, imp.src, depth + 1 FROM b JOIN imp ON imp.dst = b.node WHERE depth < 2),
f AS (SELECT root AS file, count(DISTINCT node) AS affected FROM b WHERE node NOT IN (SELECT node FROM b x WHERE x.root = b.root AND x.depth = 0) GROUP BY 1),
n AS (SELECT callee_name AS name, count(DISTINCT caller_file) AS callers FROM calls GROUP BY 1)
SELECT s.file, s.name, coalesce(callers, 0) AS callers, coalesce(affected, 0) AS affected,
  CASE WHEN coalesce(callers, 0) > 20 OR coalesce(affected, 0) > 100 THEN 'high' WHEN coalesce(callers, 0) > 0 THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT DISTINCT file_path AS file, name FROM code JOIN fi ON fi.file = file_path) s LEFT JOIN f USING (file) LEFT JOIN n USING (name)""",
)
def refactor_safety_report(spark, d):
    c = A.code(spark, d)
    symbols = c.select(F.col("file_path").alias("file"), "name")
    files = c.where("brand = 'Brand#7'").select(F.col("file_path").alias("file"))
    return reports.refactor_safety(A.code_imports(c), symbols, _calls(spark, d), files)
