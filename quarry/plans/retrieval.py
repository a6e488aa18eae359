"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import adapters as A
from quarry import storage
from quarry.functions import text as T
from quarry.operators import evaluation, graph, rank, reports, vector
from quarry.plans.graphs import pagerank_steps
from quarry.registry import register
from quarry.sources import postings, vectors

Q = A.QUERIES


def tok_sql(x: str) -> str:
    """The tokenizer in SQL."""
    return (
        f"flatten(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+'), lambda t: length(t) >= 2), "
        "lambda r: CASE WHEN contains(r, '_') THEN list_concat([r], list_filter(string_split(r, '_'), "
        "lambda p: length(p) >= 2)) ELSE [r] END))"
    )


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE))))"


def cos_sql(a: str, b: str) -> str:
    return f"round({_DOT.format(a=a, b=b)} / ({_NORM.format(a=a)} * {_NORM.format(a=b)}), 6)"


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
BASE = f"symbols AS ({A.DOCUMENTS_SQL}), q AS ({A.queries_sql(Q)})"
SEM = f"""sv AS (SELECT vec_id AS id, embedding FROM embeddings), qv AS ({A.QUERY_VECTORS_SQL}),
se AS (SELECT query_id, id, {cos_sql("embedding", "vector")} AS score FROM sv, qv)"""


def _fields() -> str:
    return " UNION ALL ".join(f"SELECT id, unnest({tok_sql(f)}) AS term, {w}::DOUBLE AS w FROM symbols" for f, w in rank.FIELD_WEIGHTS.items())


TERMS = f"""terms AS (SELECT id, term, sum(w) AS tf_w FROM ({_fields()}) GROUP BY id, term),
len AS (SELECT id, sum(tf_w) AS dl FROM terms GROUP BY id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
asked AS (SELECT DISTINCT query_id, unnest({tok_sql("query")}) AS term FROM q),
df AS (SELECT term, count(*) AS df FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY term),
nt AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id),
scored AS (SELECT a.query_id, t.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf_w * 2.2 / (tf_w + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS s,
  count(*) AS matched FROM terms t JOIN asked a USING (term) JOIN df USING (term) JOIN len USING (id), st GROUP BY a.query_id, t.id),
bm AS (SELECT query_id, id, matched, round(s * CASE WHEN matched / n_terms >= 0.8 THEN 1.1 ELSE 1.0 END * CASE WHEN is_test THEN 0.5 ELSE 1.0 END
  * CASE WHEN is_generated THEN 0.5 ELSE 1.0 END * CASE WHEN exported THEN 1.3 ELSE 1.0 END, 9) AS score, is_test, is_generated FROM scored JOIN nt USING (query_id) JOIN symbols USING (id)),
ranked AS (SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)"""


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The folder of the index of a directory's documents; made once a session, and read by all queries."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        folder = storage.new_folder(spark, "index")
        postings.merge(A.documents(spark, d), folder, 0, rank.FIELD_WEIGHTS)
        _INDEXES[key] = folder
    return _INDEXES[key]


def _bm25(spark, d, k=10, **kinds):
    return rank.bm25_indexed(spark, _index(spark, d), A.queries_frame(spark, Q), k, **kinds)


@register(
    "bm25_symbol_search",
    f"""WITH {BASE}, {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE NOT is_test AND NOT is_generated)
SELECT query_id, id, round(score, 6) AS score, matched, rank FROM r WHERE rank <= 10""",
)
def bm25_symbol_search(spark, d):
    return _bm25(spark, d, tests=False, generated=False).select("query_id", "id", F.round("score", 6).alias("score"), "matched", "rank")


@register(
    "bm25_adjusted",
    f"WITH {BASE}, {TERMS} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 50",
)
def bm25_adjusted(spark, d):
    """With tests and generated files, which count half, and exported symbols, which count more, all before the cut."""
    return _bm25(spark, d, 50).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register(
    "bm25_retriever",
    f"""WITH {BASE}, {TERMS}, o AS (SELECT * FROM bm WHERE NOT is_test AND NOT is_generated QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50),
x AS (SELECT query_id, id, matched, round(o.score * CASE WHEN starts_with(file_path, 'core/') AND query_id IN ('q1', 'q2') THEN 1.08 ELSE 1.0 END, 9) AS score FROM o JOIN symbols USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def bm25_retriever(spark, d):
    recent = spark.createDataFrame([("q1", "core/"), ("q2", "core/")], "query_id string, prefix string")
    got = rank.retrieve(A.documents(spark, d), A.queries_frame(spark, Q), 10, recent, folder=_index(spark, d))
    return got.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_FTS = f"""ft AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, name_path, signature)), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM symbols),
fs AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ft),
fa AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[\\s_-]+'), lambda x: x <> '')) AS prefix FROM q),
fp AS (SELECT DISTINCT prefix FROM fa),
fh AS (SELECT id, prefix, len(t) AS dl, len(list_filter(t, lambda x: starts_with(x, prefix))) AS tf FROM ft, fp WHERE len(list_filter(t, lambda x: starts_with(x, prefix))) > 0),
fd AS (SELECT prefix, count(*) AS df FROM fh GROUP BY 1),
fr AS (SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score FROM fh JOIN fd USING (prefix) JOIN fa USING (prefix), fs GROUP BY 1, 2),
fx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fr)"""


@register("fts_prefix_search", f"WITH {BASE}, {_FTS} SELECT query_id, id, round(score, 6) AS score, rank FROM fx WHERE rank <= 10")
def fts_prefix_search(spark, d):
    return rank.fts_prefix_indexed(spark, _index(spark, d), A.queries_frame(spark, Q)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_VERBS = "[" + ", ".join(f"'{v}'" for v in T.VERBS) + "]"
LEX = f"""lt AS (SELECT query_id, id, kind, lower(query) AS ql, regexp_replace(lower(query), '[\\s-]', '_', 'g') AS sq, lower(name) AS n,
  lower(signature) AS s, lower(name_path) AS np, lower(file_path) AS p,
  list_filter(regexp_split_to_array(lower(query), '[\\s_-]+'), lambda t: length(t) >= 2) AS toks FROM symbols, q),
lr AS (SELECT *, len(list_filter(toks, lambda t: contains(n, t))) / greatest(len(toks), 1) AS nr, len(list_filter(toks, lambda t: contains(s, t))) / greatest(len(toks), 1) AS sr,
  len(list_filter(toks, lambda t: contains(p, t))) / greatest(len(toks), 1) AS pr,
  CASE WHEN kind IN ('function', 'method') AND list_has_any(toks, {_VERBS}) THEN 8
       WHEN kind IN ('class', 'interface', 'enum') AND NOT list_has_any(toks, {_VERBS}) THEN 5 ELSE 0 END AS bonus FROM lt),
ls AS (SELECT query_id, id, CAST(CASE WHEN n = ql THEN 100 WHEN contains(n, ql) THEN 60 WHEN contains(s, ql) THEN 30 WHEN contains(np, ql) THEN 20
  WHEN n = sq THEN 80 WHEN contains(sq, n) AND contains(n, '_') THEN 70 WHEN contains(n, sq) AND contains(sq, '_') THEN 65
  WHEN nr > 0 THEN least(CAST(trunc(15 + 40 * nr) AS INT) + CAST(trunc(5 * sr) AS INT), 55) + bonus
  WHEN sr > 0 THEN CAST(trunc(5 + 20 * sr) AS INT) + bonus
  WHEN pr > 0 THEN CAST(trunc(greatest(1 + 4 * pr, 1)) AS INT) + bonus END AS BIGINT) AS score FROM lr),
lx AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ls WHERE score IS NOT NULL)"""


@register("lexical_symbol_score", f"WITH {BASE}, {LEX} SELECT query_id, id, score, rank FROM lx WHERE rank <= 20")
def lexical_symbol_score(spark, d):
    return rank.lexical(A.documents(spark, d), A.queries_frame(spark, Q), 20)


_RRF = """lanes AS (SELECT query_id, id AS key, {sp} / (60 + rank) AS part, 'sparse' AS lane FROM (SELECT * FROM ranked JOIN caps USING (query_id) WHERE rank <= cap_sp AND rank <= 20)
  UNION ALL SELECT query_id, id, 1.0 / (60 + rank), 'structural' FROM lx WHERE rank <= 20
  UNION ALL SELECT query_id, id, {se} / (60 + rank), 'semantic' FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM se) JOIN caps USING (query_id) WHERE rank <= cap_se),
ul AS (SELECT query_id, id AS key, 0.6 / (60 + rank) AS part FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY line, id) AS rank FROM symbols, q) WHERE rank <= 5),
f AS (SELECT query_id, key, round(sum(part), 12) AS rrf FROM (SELECT query_id, key, part FROM lanes UNION ALL SELECT query_id, key, part FROM ul WHERE (query_id, key) IN (SELECT (query_id, key) FROM lanes)) GROUP BY query_id, key),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, key) AS rank, min(rrf) OVER (PARTITION BY query_id) AS lo, max(rrf) OVER (PARTITION BY query_id) AS hi FROM f),
fused AS (SELECT query_id, key, rank, CAST(CASE WHEN hi - lo > 1e-9 THEN round((rrf - lo) / (hi - lo) * 99 + 1) ELSE 100 END AS BIGINT) AS relevance FROM t)"""
_CAPS = "caps AS (SELECT query_id, CASE WHEN query_id IN ('q5', 'q6') THEN 4 WHEN query_id IN ('q2', 'q3') THEN 3 ELSE 2 END AS cap_sp, CASE WHEN query_id IN ('q5', 'q6') THEN 6 WHEN query_id IN ('q2', 'q3') THEN 2 ELSE 3 END AS cap_se FROM q)"
_SP = "CASE WHEN query_id = 'q1' THEN 1.0 WHEN query_id IN ('q5', 'q6') THEN 0.6 ELSE 0.8 END"
_SE = "CASE WHEN query_id = 'q1' THEN 0.6 WHEN query_id IN ('q5', 'q6') THEN 1.2 ELSE 1.0 END"


def _fused(spark, d, adaptive=False):
    s, q = A.documents(spark, d), A.queries_frame(spark, Q)
    semantic = rank.top_k(vector.scores(A.symbol_vectors(spark, d), A.query_vectors(spark, d)), 20, "score", "id")
    lanes = {"sparse": _bm25(spark, d, 20), "structural": rank.lexical(s, q, 20), "semantic": semantic}
    lanes = {k: v.select("query_id", F.col("id").alias("key"), "rank") for k, v in lanes.items()}
    recent = s.crossJoin(F.broadcast(q)).select("query_id", F.col("id").alias("key"), (-F.col("line")).alias("o"))  # corpus x six queries
    return lanes, rank.fuse(lanes, q, rank.top_k(recent, 5, "o", "key"), adaptive)


@register("rrf_fusion", f"WITH {BASE}, {TERMS}, {LEX}, {SEM}, {_CAPS}, {_RRF.format(sp='0.8', se='1.0')} SELECT * FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d)[1].select("query_id", "key", "rank", "relevance")


@register("rrf_adaptive", f"WITH {BASE}, {TERMS}, {LEX}, {SEM}, {_CAPS}, {_RRF.format(sp=_SP, se=_SE)} SELECT * FROM fused")
def rrf_adaptive(spark, d):
    return _fused(spark, d, adaptive=True)[1].select("query_id", "key", "rank", "relevance")


@register(
    "rank_evidence",
    f"""WITH {BASE}, {TERMS}, {LEX}, {SEM}, {_CAPS}, {_RRF.format(sp='0.8', se='1.0')}, sl AS (SELECT query_id, id AS key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM se)
SELECT sl.query_id, sl.key, sl.rank, fused.rank IS NOT NULL AS selected, fused.rank AS final_rank FROM sl LEFT JOIN fused ON fused.query_id = sl.query_id AND fused.key = sl.key WHERE sl.rank <= 5""",
)
def rank_evidence(spark, d):
    lanes, fused = _fused(spark, d)
    return rank.evidence(lanes["semantic"], fused)


_RANKS: dict[tuple[str, str], str] = {}


def _importance(spark, d):
    """(node: a file, score): PageRank of the files over the imports within packages; made once a session, as the index is."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RANKS:
        folder = storage.new_folder(spark, "ranks")
        graph.pagerank(A.package_edges(spark, d)).write.parquet(folder)
        _RANKS[key] = folder
    pr = spark.read.parquet(_RANKS[key])
    return A.documents(spark, d).select(F.col("id").alias("node"), "file_path").hint("merge").join(pr, "node").select(F.col("file_path").alias("node"), "score")


_IMP = f"e AS ({A.PACKAGE_EDGES_SQL}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {pagerank_steps()}, im AS (SELECT node AS id, score FROM r{graph.ROUNDS})"


def _blend_inputs(spark, d):
    s, q = A.documents(spark, d), A.queries_frame(spark, Q)
    c = F.col
    text = rank.lexical_score(c("query"), c("name"), c("signature"), c("name_path"), c("file_path"), c("kind"))
    sem = vector.scores(A.symbol_vectors(spark, d), A.query_vectors(spark, d)).withColumnRenamed("score", "semantic")
    sem = storage.written(sem, "semantic")  # read for each query's range, and for its rows
    own = ["id", "kind", "name", "name_path", "file_path", "signature"]
    # scored, and gated, before anything is joined that a row which is left out would not need
    rows = s.select(*own).crossJoin(rank.batch(q)).withColumn("text", F.coalesce(text, F.lit(0)).cast("double"))
    rows = rows.join(sem, ["query_id", "id"], "left").where((F.col("text") > 0) | (F.col("semantic") >= rank.GATE))
    imp = storage.written(_importance(spark, d).select(F.col("node").alias("file_path"), F.col("score").alias("importance")), "importance")
    n = imp.agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = rows.join(imp, "file_path", "left").join(A.recency(spark, d), "id", "left").crossJoin(F.broadcast(n))  # one row
    zero = F.lit(0.0)
    rows = rows.withColumn("importance", F.coalesce("importance", zero)).withColumn("recency", F.coalesce("recency", zero))
    columns = ["query_id", "query", *own, "text", "importance", "n", "recency", "semantic"]
    return storage.written(rows.select(*columns), "blend"), rank.semantic_range(q, sem)


def _blended(spark, d):
    rows, per = _blend_inputs(spark, d)
    return rank.blend(rows, per=per)


_BLEND = f"""{BASE}, {LEX}, {SEM}, {_IMP}, rc AS ({A.RECENCY_SQL}),
bi AS (SELECT q.query_id, s.id, s.file_path, s.name, s.signature, s.kind, coalesce(ls.score, 0) AS text, coalesce(im.score, 0) * 100 * (SELECT count(*) FROM im) AS imp, coalesce(recency, 0) AS rec, se.score AS sem
  FROM symbols s CROSS JOIN q LEFT JOIN ls ON ls.query_id = q.query_id AND ls.id = s.id LEFT JOIN se ON se.query_id = q.query_id AND se.id = s.id LEFT JOIN im ON im.id = s.id LEFT JOIN rc ON rc.id = s.id),
bw AS (SELECT *, greatest(max(sem) OVER (PARTITION BY query_id), 0.01) AS best,
  CASE WHEN query_id = 'q1' THEN [0.65, 0.10, 0.05, 0.20] WHEN query_id IN ('q5', 'q6') THEN [0.20, 0.05, 0.05, 0.70] ELSE [0.50, 0.10, 0.10, 0.30] END AS w,
  CASE query_id WHEN 'q5' THEN CASE WHEN kind IN ('function', 'method') THEN 10 WHEN kind IN ('class', 'interface', 'enum') THEN -8 ELSE 0 END
    + CASE WHEN starts_with(file_path, 'benchmarks/') THEN -28 WHEN starts_with(file_path, 'my-cli/') THEN -8 WHEN starts_with(file_path, 'core/src/tools/') THEN -4 ELSE 6 END
  WHEN 'q6' THEN CASE WHEN kind IN ('function', 'method') THEN 12 WHEN kind IN ('class', 'interface', 'enum') THEN -6 WHEN kind = 'variable' THEN -2 ELSE 0 END + CASE WHEN starts_with(file_path, 'benchmarks/') THEN -14 ELSE 0 END ELSE 0 END AS prior FROM bi),
bl AS (SELECT query_id, id, file_path, name, signature, CAST(greatest(trunc(round(CAST(text AS DOUBLE) * CAST(w[1] AS DOUBLE) + least(CAST(imp AS DOUBLE), 100) * CAST(w[2] AS DOUBLE)
  + least(CAST(rec AS DOUBLE) * 100, 100) * CAST(w[3] AS DOUBLE) + least(coalesce(sem, 0) / best * 100, 100) * CAST(w[4] AS DOUBLE) + prior, 9)), 1) AS BIGINT) AS score
  FROM bw WHERE text > 0 OR sem >= 0.08)"""


@register("multi_signal_blend", f"WITH {_BLEND} SELECT query_id, id, score FROM bl")
def multi_signal_blend(spark, d):
    return _blended(spark, d).select("query_id", "id", "score")


@register(
    "blend_partial_sort",
    f"""WITH {_BLEND}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM bl)
SELECT query_id, id, score, rank FROM r WHERE n <= 200 OR rank <= 100""",
)
def blend_partial_sort(spark, d):
    return rank.best_of(_blended(spark, d), "score", "id").select("query_id", "id", "score", "rank")


_DIVERSE = """dn AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, folder ORDER BY score DESC, id) AS f FROM (SELECT *, regexp_extract(file_path, '^(.*)/', 1) AS folder FROM bl)),
dv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 10 AND f > 3 THEN 1 ELSE 0 END, score DESC, id) AS rank FROM dn)"""


def _diverse(spark, d):
    """Ten a query, three a folder first: the files of these sources have one symbol each."""
    rows = _blended(spark, d).withColumn("path", F.col("file_path"))
    return rank.diverse(rows.withColumn("file_path", F.regexp_extract("path", "^(.*)/", 1)), 10)


@register("diversity_rerank", f"WITH {_BLEND}, {_DIVERSE} SELECT query_id, id, folder, score, rank FROM dv WHERE rank <= 10")
def diversity_rerank(spark, d):
    return _diverse(spark, d).select("query_id", "id", F.col("file_path").alias("folder"), "score", "rank")


@register(
    "ranked_context_budget",
    f"""WITH {_BLEND}, {_DIVERSE},
u AS (SELECT query_id, id, rank, CAST(sum(strlen(name) + strlen(file_path) + strlen(signature) + 80) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM dv WHERE rank <= 10)
SELECT * FROM u WHERE rank = 1 OR used <= 600""",
)
def ranked_context_budget(spark, d):
    size = F.octet_length("name") + F.octet_length("path") + F.octet_length("signature") + 80
    return rank.budget(_diverse(spark, d).withColumn("size", size), "size", 600).select("query_id", "id", "rank", "used")


@register(
    "hybrid_search",
    f"""WITH {BASE}, {_FTS}, {SEM}, {_IMP}, nm AS (SELECT query_id, name, jaro_winkler_similarity(lower(name), lower(query)) AS s FROM (SELECT DISTINCT name FROM symbols), q WHERE contains(lower(name), lower(query)[1:2])),
l AS (SELECT query_id, id, 100.0 AS score, 0 AS lane FROM symbols JOIN q ON name = query QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 30
  UNION ALL SELECT query_id, id, greatest(80.0 + greatest(-score, -40.0), 40.0), 1 FROM fx WHERE rank <= 30
  UNION ALL SELECT query_id, id, s * 100, 2 FROM symbols JOIN nm USING (name) WHERE s >= 0.6
  UNION ALL SELECT query_id, id, score * 90, 3 FROM se WHERE score > 0.15),
o AS (SELECT query_id, id, score, lane FROM l QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY lane) = 1),
b AS (SELECT o.query_id, o.id, file_path, round(o.score + CASE WHEN lane < 3 AND se.score > 0.10 THEN least(se.score * 15, 10) ELSE 0 END + coalesce(im.score / (SELECT max(score) FROM im) * 5, 0), 9) AS score,
  ['exact', 'fts', 'fuzzy', 'semantic'][lane + 1] AS match FROM o JOIN symbols USING (id) LEFT JOIN se ON se.query_id = o.query_id AND se.id = o.id LEFT JOIN im ON im.id = o.id)
SELECT query_id, id, match, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 30""",
)
def hybrid_search(spark, d):
    sem = vector.scores(A.symbol_vectors(spark, d), A.query_vectors(spark, d))
    out = rank.hybrid(A.documents(spark, d), A.queries_frame(spark, Q), 30, 0.6, sem, _importance(spark, d), folder=_index(spark, d))
    return out.select("query_id", "id", "match", F.round("score", 5).alias("score"), "rank")


_VQ = "v AS (SELECT id, file_path, embedding FROM (" + A.VECTORS_SQL + ")), vq AS (SELECT CAST(id AS VARCHAR) AS query_id, id AS qid, embedding AS vector FROM v WHERE id % 100 = 0)"
def _vector_queries(v):
    """A stated query set: the rows whose id is divisible by 100."""
    return v.where("id % 100 = 0").select(F.col("id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))


@register(
    "vector_search",
    f"""WITH {_VQ}, s AS (SELECT query_id, id, {cos_sql("embedding", "vector")} AS score FROM v, vq)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_search(spark, d):
    v = A.vectors(spark, d)
    return vector.search(v, _vector_queries(v))


@register(
    "vector_search_l2",
    f"""WITH {_VQ}, s AS (SELECT query_id, id, round(1 - sqrt(list_sum(list_transform(list_zip(embedding, vector),
  lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS score FROM v, vq)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
)
def vector_search_l2(spark, d):
    v = A.vectors(spark, d)
    return vector.search(v, _vector_queries(v), metric="l2")


@register(
    "vector_search_scoped",
    f"""WITH {_VQ}, s AS (SELECT vq.query_id, v.id, {cos_sql("v.embedding", "vector")} AS score FROM v JOIN vq ON v.file_path = concat('f', CAST(vq.qid % 10 AS VARCHAR)))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
)
def vector_search_scoped(spark, d):
    v = A.vectors(spark, d)
    q = v.where("id % 100 = 0").select(
        F.col("id").cast("string").alias("query_id"),
        F.concat(F.lit("f"), (F.col("id") % 10).cast("string")).alias("file_path"),
        F.col("embedding").alias("vector"),
    )
    return vector.knn(v, q, 5, within="file_path")


@register(
    "similar_code",
    f"""WITH {_VQ}, s AS (SELECT qid AS query_id, id, {cos_sql("embedding", "vector")} AS score FROM v, vq WHERE id <> qid)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
)
def similar_code(spark, d):
    v = A.vectors(spark, d)
    return vector.similar(v, v.where("id % 100 = 0").select("id")).select("query_id", "id", "score", "rank")


_PAIRS = f"""v AS ({A.VECTORS_SQL}), p AS (SELECT a.id AS a, b.id AS b, a.file_path AS file_a, b.file_path AS file_b, {cos_sql("a.embedding", "b.embedding")} AS similarity FROM v a JOIN v b ON a.id < b.id)"""


@register(
    "duplicate_pairs",
    f"WITH {_PAIRS} SELECT a, b, file_a, file_b, similarity FROM p WHERE similarity >= 0.4 ORDER BY similarity DESC, a, b LIMIT 50",
)
def duplicate_pairs(spark, d):
    # these vectors are random: no two are closer than 0.6; the recall is so high as the SQL compares all pairs
    return vector.duplicate_pairs(A.vectors(spark, d), 0.4, 50, recall=0.9999)


@register(
    "duplicate_pairs_filtered",
    f"""WITH {_PAIRS}, s AS ({A.DOCUMENTS_SQL}), t AS (SELECT id, file_path, name, kind, list_distinct(list_filter(regexp_extract_all(lower(body), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in T.BODY_STOPWORDS)
    + """], w))) AS w FROM s),
j AS (SELECT p.a, p.b, x.file_path AS file_a, y.file_path AS file_b, similarity, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM p JOIN t x ON x.id = p.a JOIN t y ON y.id = p.b WHERE similarity >= 0.4)
SELECT *, CASE WHEN similarity >= 0.85 AND jaccard < 0.5 THEN 'signature_only' ELSE 'kept' END AS reason FROM j ORDER BY similarity DESC, a, b LIMIT 50""",
)
def duplicate_pairs_filtered(spark, d):
    s = A.documents(spark, d).select("id", "file_path", "name", "kind", F.col("body").alias("text"))
    return vector.duplicate_pairs(A.vectors(spark, d).select("id", "embedding").join(s, "id"), 0.4, 50, recall=0.9999)


_MEANS = """m AS (SELECT file_path, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT file_path, embedding, unnest(range(1, 65)) AS i FROM v) GROUP BY file_path, i)"""


@register("file_mean_embedding", f"WITH v AS ({A.VECTORS_SQL}), {_MEANS} SELECT file_path, CAST(i - 1 AS BIGINT) AS at, round(x, 6) AS mean FROM m")
def file_mean_embedding(spark, d):
    m = vector.file_means(A.vectors(spark, d))
    return m.select("file_path", F.posexplode("embedding").alias("at", "x")).select(
        "file_path", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("mean")
    )


@register(
    "classify_symbol",
    f"""WITH v AS ({A.VECTORS_SQL}), {_MEANS}, c AS (SELECT file_path AS category, list(x ORDER BY i) AS vector FROM m GROUP BY file_path),
s AS (SELECT id, category, {cos_sql("embedding", "vector")} AS score FROM v, c)
SELECT id, category, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category DESC) = 1""",
)
def classify_symbol(spark, d):
    v = A.vectors(spark, d)
    cats = vector.file_means(v).select(F.col("file_path").alias("category"), F.col("embedding").alias("vector"))
    return vector.classify(v, cats)


@register(
    "misplaced_code",
    f"""WITH v AS ({A.VECTORS_SQL}),
s AS (SELECT a.id, a.file_path, round(avg({_DOT.format(a="a.embedding", b="b.embedding")} / ({_NORM.format(a="a.embedding")} * {_NORM.format(a="b.embedding")})), 6) AS avg_similarity
  FROM v a JOIN v b ON a.file_path = b.file_path AND a.id <> b.id GROUP BY a.id, a.file_path)
SELECT * FROM s ORDER BY avg_similarity, id LIMIT 20""",
)
def misplaced_code(spark, d):
    return vector.misplaced(A.vectors(spark, d), 20)


@register("vector_store")
def vector_store(spark, d):
    """The documents' vectors as a store that is left in place: first without every third symbol, then without every fifth, each seventh with another text."""
    v = A.vectors(spark, d).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    s = A.documents(spark, d).select("id", "file_path", F.col("body").alias("text"))
    folder = storage.new_folder(spark, "vector-store", keep=True)
    embed = lambda rows: rows.join(v, "id").select("id", "embedding")
    # the two states of the index are defined by residues: they are the adapter, not a sample
    vectors.reconcile(s.where("id % 3 <> 0"), folder, 0, embed)
    later = s.where("id % 5 <> 0").withColumn("text", F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    vectors.reconcile(later, folder, 1, lambda rows: embed(rows).withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return vectors.rows(spark, folder)


@register(
    "embedding_reconcile",
    """WITH o AS (SELECT concat(p_name, '|', p_brand) AS key FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
n AS (SELECT concat(p_name, '|', p_brand) AS key FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN o.key IS NULL THEN 'embed' WHEN n.key IS NULL THEN 'delete' ELSE 'reuse' END AS action, count(*) AS n
FROM o FULL JOIN n ON o.key = n.key GROUP BY 1""",
)
def embedding_reconcile(spark, d):
    # the two states of the index are defined by residues: they are the adapter, not a sample
    key = F.concat("p_name", F.lit("|"), "p_brand").alias("key")
    p = A.table(spark, d, "part")
    return vector.reconcile(
        p.where("p_partkey % 3 <> 0").select(key).distinct(), p.where("p_partkey % 5 <> 0").select(key).distinct()
    )


@register(
    "query_cache_lru",
    """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS cache_key, max(ts) AS last_used, count(*) AS hits FROM events GROUP BY 1)
SELECT cache_key, hits FROM (SELECT *, row_number() OVER (ORDER BY last_used DESC, hits DESC, cache_key) AS r FROM c) WHERE r > 50""",
)
def query_cache_lru(spark, d):
    c = A.tool_calls(spark, d).groupBy(F.col("session").alias("cache_key")).agg(
        F.max("ts").alias("last_used"), F.count(F.lit(1)).alias("hits")
    )
    return vector.least_recent(c, 50).select("cache_key", "hits")


@register(
    "semantic_rerank",
    f"""WITH {BASE}, {SEM}, x AS (SELECT se.query_id, query, se.id, name, signature, name_path, file_path, se.score FROM se JOIN symbols USING (id) JOIN q USING (query_id)),
t AS (SELECT *, list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS toks,
  lower(concat_ws(' ', name, trim(replace(name, '_', ' ')), name_path, signature, file_path)) AS hay FROM x)
SELECT query_id, id, round(score * 0.75 + len(list_filter(toks, lambda t: contains(hay, t))) / greatest(len(toks), 1) * 0.25, 8) AS score FROM t""",
)
def semantic_rerank(spark, d):
    rows = vector.scores(A.symbol_vectors(spark, d), A.query_vectors(spark, d)).join(A.documents(spark, d), "id").join(F.broadcast(A.queries_frame(spark, Q)), "query_id")
    return vector.semantic_rerank(rows).select("query_id", "id", "score")


@register(
    "body_jaccard",
    """WITH t AS (SELECT doc_id, source, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains(["""
    + ", ".join(f"'{w}'" for w in T.BODY_STOPWORDS)
    + """], w))) AS w FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1 WHERE len(list_concat(a.w, b.w)) > 0""",
)
def body_jaccard(spark, d):
    t = A.table(spark, d, "documents").select("doc_id", T.body_tokens(F.col("text")).alias("w"))
    a = t.select(F.col("doc_id").alias("a"), F.col("w").alias("wa"))
    b = t.select(F.col("doc_id").alias("b"), F.col("w").alias("wb"), (F.col("doc_id") - 1).alias("a"))
    return a.join(b, "a").select("a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard")).where(
        "jaccard IS NOT NULL"
    )


_LABELS = f"""lab AS (SELECT DISTINCT query_id, symbols.id AS key FROM q JOIN symbols ON contains(lower(replace(query, ' ', '_')), name))"""


def _labels(spark, d):
    q = A.queries_frame(spark, Q)
    return A.symbols(spark, d).join(F.broadcast(q), F.contains(F.lower(F.replace("query", F.lit(" "), F.lit("_"))), F.col("name"))).select(
        "query_id", F.col("id").alias("key")
    ).distinct()


@register(
    "retrieval_mrr",
    f"""WITH {BASE}, {LEX}, {_LABELS},
h AS (SELECT lab.query_id, min(lx.rank) AS r FROM lab LEFT JOIN lx ON lx.query_id = lab.query_id AND lx.id = lab.key AND lx.rank <= 20 GROUP BY lab.query_id)
SELECT count(*) AS queries, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS acc1,
  round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS acc3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS acc5 FROM h""",
)
def retrieval_mrr(spark, d):
    res = rank.lexical(A.documents(spark, d), A.queries_frame(spark, Q), 20).withColumnRenamed("id", "key")
    return evaluation.retrieval(res, _labels(spark, d))


@register(
    "retrieval_prf",
    f"""WITH {BASE}, {LEX}, {_LABELS}, f AS (SELECT query_id, id AS key FROM lx WHERE rank <= 20),
c AS (SELECT count(*) FILTER (f.key IS NOT NULL AND lab.key IS NOT NULL) AS tp, count(*) FILTER (lab.key IS NULL) AS fp, count(*) FILTER (f.key IS NULL) AS fn
  FROM f FULL JOIN lab ON f.query_id = lab.query_id AND f.key = lab.key),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0), 6) AS f FROM r""",
)
def retrieval_prf(spark, d):
    res = rank.lexical(A.documents(spark, d), A.queries_frame(spark, Q), 20).withColumnRenamed("id", "key")
    return evaluation.prf(res, _labels(spark, d), ["query_id", "key"], 0.5)


@register(
    "retrieval_suffix_prf",
    f"""WITH {BASE}, {LEX}, lb AS (SELECT DISTINCT query_id, name, concat(replace(name, ' ', '_'), '_', CAST(id AS VARCHAR), '.', regexp_extract(file_path, '[a-z]+$')) AS suffix FROM q JOIN symbols ON contains(lower(replace(query, ' ', '_')), name)),
f AS (SELECT lx.query_id, name, file_path FROM lx JOIN symbols USING (id) WHERE rank <= 20),
m AS (SELECT f.*, lb.suffix FROM f LEFT JOIN lb ON lb.query_id = f.query_id AND lb.name = f.name AND ends_with(file_path, concat('/', lb.suffix))),
c AS (SELECT (SELECT count(DISTINCT (query_id, name, suffix)) FROM m WHERE suffix IS NOT NULL) AS tp, (SELECT count(*) FROM m WHERE suffix IS NULL) AS fp, (SELECT count(*) FROM lb) AS n),
r AS (SELECT tp, fp, n - tp AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(n, 0), 0) AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f FROM r""",
)
def retrieval_suffix_prf(spark, d):
    s, q = A.documents(spark, d), A.queries_frame(spark, Q)
    found = rank.lexical(s, q, 20).join(s.select("id", "name", "file_path"), "id")
    meant = F.contains(F.lower(F.replace("query", F.lit(" "), F.lit("_"))), F.col("name"))
    labels = s.join(F.broadcast(q), meant).select("query_id", "name", F.element_at(F.split("file_path", "/"), -1).alias("suffix"))  # corpus x six queries
    return evaluation.suffix_prf(found, labels)


@register(
    "retrieval_recall",
    f"""WITH {BASE}, {LEX}, {_LABELS}
SELECT lab.query_id, round(avg(CASE WHEN lx.id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM lab
LEFT JOIN lx ON lx.query_id = lab.query_id AND lx.id = lab.key AND lx.rank <= 10 GROUP BY lab.query_id""",
)
def retrieval_recall(spark, d):
    res = rank.lexical(A.documents(spark, d), A.queries_frame(spark, Q), 10).withColumnRenamed("id", "key")
    return evaluation.recall_at(res, _labels(spark, d), 10)


_RUNS = """SELECT DISTINCT {key}, array_to_string(w[i:i+11], ' ') AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i
  FROM (SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM {t}) WHERE len(w) >= 12)"""


@register(
    "contamination_audit",
    f"""WITH i AS ({_RUNS.format(key="item_id", t="benchmark")}), c AS ({_RUNS.format(key="doc_id", t="documents")})
SELECT item_id, count(DISTINCT doc_id) AS docs FROM i JOIN c USING (h) GROUP BY item_id""",
)
def contamination_audit(spark, d):
    return evaluation.contamination(A.table(spark, d, "benchmark"), A.table(spark, d, "documents"))


@register(
    "contamination_overlap",
    """WITH d AS (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents), i AS (SELECT * FROM d WHERE doc_id % 100 = 0)
SELECT i.doc_id AS item_id, (SELECT count(*) FROM d WHERE d.text = i.text) AS exact, (SELECT count(*) FROM d WHERE d.norm = i.norm) AS normalised FROM i""",
)
def contamination_overlap(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    return evaluation.overlaps(docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "item_id"), docs)


@register(
    "contamination_near",
    f"WITH {_VQ}, s AS (SELECT query_id, id, {cos_sql('embedding', 'vector')} AS score FROM v, vq) SELECT * FROM s WHERE score >= 0.3",
)
def contamination_near(spark, d):
    v = A.vectors(spark, d)
    return evaluation.near_items(_vector_queries(v), v.select("id", "embedding"), 0.3)


@register(
    "user_context_lane",
    """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS position, value FROM events)
SELECT CAST(user_id AS VARCHAR) AS query_id, position, round(0.5 * (1.0 - 0.15 * position) + 0.5 * (value / 1000), 6) AS score FROM e WHERE position < 5""",
)
def user_context_lane(spark, d):
    from pyspark.sql.window import Window

    by = Window.partitionBy("session").orderBy(F.col("ts").desc(), F.col("call_id").desc())
    rows = A.tool_calls(spark, d).select(
        F.col("session").alias("query_id"),
        (F.row_number().over(by) - 1).cast("long").alias("position"),
        (F.col("elapsed_ms") / 1000).alias("similarity"),
    )
    return rank.user_lane(rows.where("position < 5")).select("query_id", "position", F.round("score", 6).alias("score"))


# --- compositions ----------------------------------------------------------------------------------


#: What users asked: the batch, and the names of parts as identifiers, as phrases and in sentences.
ASKED_SQL = f"""{A.queries_sql(Q)} UNION ALL SELECT concat('p', p_partkey), CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') WHEN p_size % 3 = 1 THEN p_name ELSE concat('find the ', p_name, ' gear handler') END FROM part"""


def _asked(spark, d):
    name, size = F.col("p_name"), F.col("p_size")
    text = F.when(size % 3 == 0, F.replace(name, F.lit(" "), F.lit("_"))).when(size % 3 == 1, name)
    text = text.otherwise(F.concat(F.lit("find the "), name, F.lit(" gear handler")))
    rows = A.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("query_id"), text.alias("query"))
    return A.queries_frame(spark, Q).unionAll(rows)


@register(
    "query_analysis",
    f"""WITH q AS ({ASKED_SQL}), x AS (SELECT *, len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda w: w <> '')) AS n,
  len(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)))) AS t FROM q)
SELECT query_id, CASE WHEN n >= 4 THEN 'sentence' WHEN n = 1 AND regexp_matches(query, '_|[A-Z]') THEN 'identifier' ELSE 'phrase' END AS class,
  n = 1 AND regexp_matches(query, '^[A-Za-z0-9_]+$') AS lexical_only, t BETWEEN 2 AND 4 AS prefer_sparse FROM x""",
)
def query_analysis(spark, d):
    return reports.analyzed(_asked(spark, d))


_TITLE = "concat(upper(x[1]), x[2:])"


@register(
    "query_expansion",
    f"""WITH q AS ({ASKED_SQL}), w AS (SELECT query_id, query, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: length(x) > 2) AS w FROM q),
g AS (SELECT query_id, w[i:i + n - 1] AS g FROM (SELECT query_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n AND len(w) BETWEEN 2 AND 6))
SELECT query_id, query AS term FROM q UNION SELECT query_id, array_to_string(g, '_') FROM g
UNION SELECT query_id, array_to_string(list_transform(w, lambda x: {_TITLE}), '') FROM w WHERE len(w) BETWEEN 2 AND 6
UNION SELECT query_id, concat(w[1], array_to_string(list_transform(w[2:], lambda x: {_TITLE}), '')) FROM w WHERE len(w) BETWEEN 2 AND 6
UNION SELECT query_id, concat(lower(p[1]), array_to_string(list_transform(p[2:], lambda x: concat(upper(x[1]), lower(x[2:]))), '')) FROM (SELECT query_id, string_split(query, '_') AS p FROM q WHERE query LIKE '%\\_%' ESCAPE '\\') UNION SELECT query_id, unnest(['dispatch', 'route']) FROM q WHERE query LIKE '%gear%' AND query LIKE '%handler%'""",
)
def query_expansion(spark, d):
    return reports.expanded(_asked(spark, d), [(("gear", "handler"), ("dispatch", "route"))])


@register(
    "query_bridges",
    f"""WITH q AS ({A.queries_sql(Q)}), b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word, concat(lower(p_type), '_', split_part(p_name, ' ', 2)) AS term FROM part)
SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^a-z0-9]+')) AS word FROM q) JOIN b USING (word)""",
)
def query_bridges(spark, d):
    """Words of questions and terms of code that parts put side by side."""
    word = F.split("p_name", " ")[1]
    table = A.table(spark, d, "part").select(word.alias("word"), F.concat(F.lower("p_type"), F.lit("_"), word).alias("term")).distinct()
    return reports.bridged(A.queries_frame(spark, Q), table)


@register(
    "embedding_text",
    f"""WITH {BASE} SELECT id, concat(kind, ' ', name, ' (', replace(name, '_', ' '), ') (in ', split_part(name_path, '/', 1), ') [', split_part(file_path, '/', len(string_split(file_path, '/')) - 1), '] in ',
  split_part(file_path, '/', len(string_split(file_path, '/'))), ': ', signature) AS text, trim(regexp_replace(doc_comment, '^ *(//|#) ', '')) AS doc FROM symbols""",
)
def embedding_text(spark, d):
    c = F.col
    text = T.embedding_text(c("kind"), c("name"), c("name_path"), c("file_path"), c("signature"))
    return A.documents(spark, d).select("id", text.alias("text"), T.leading_doc(F.split("body", "\n"), F.lit(5)).alias("doc"))


@register(
    "analyze_change_request",
    f"""WITH {BASE}, {TERMS}, ch AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01'),
r AS (SELECT ranked.query_id, file_path, min(rank) AS first, bool_or(id IN (SELECT id FROM ch)) AS changed FROM ranked JOIN symbols USING (id) WHERE rank <= 50 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY changed DESC, first, file_path) AS rank FROM r WHERE NOT starts_with(file_path, 'tests/') AND NOT starts_with(file_path, 'benchmarks/'))
SELECT query_id, file_path, changed, rank FROM k WHERE rank <= 5""",
)
def analyze_change_request(spark, d):
    docs = A.documents(spark, d)
    late = A.table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp")).select(F.col("l_partkey").alias("id")).distinct()
    return reports.change_request(_bm25(spark, d, 50), docs, docs.join(late, "id").select("file_path"))


@register(
    "sparse_coverage_bonus",
    f"""WITH {BASE}, x AS (SELECT query_id, id, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))) AS toks, lower(name) AS n FROM symbols, q),
s AS (SELECT query_id, id, len(list_filter(toks, lambda t: regexp_matches(n, concat('(^|[^0-9a-z])', t, '([^0-9a-z]|$)')))) / len(toks) AS share FROM x WHERE len(toks) >= 2)
SELECT query_id, id, round((share - 0.6) / 0.4 * 20, 4) AS bonus FROM s WHERE share >= 0.6""",
)
def sparse_coverage_bonus(spark, d):
    rows = A.symbols(spark, d).crossJoin(F.broadcast(A.queries_frame(spark, Q)))  # corpus x five queries
    toks = T.query_tokens(F.col("query"))
    share = F.size(F.filter("toks", lambda t: T.has_word(F.col("name"), t))) / F.size("toks")
    rows = rows.select("query_id", "id", "name", toks.alias("toks")).where("size(toks) >= 2").withColumn("share", share)
    return rows.where("share >= 0.6").select("query_id", "id", F.round(reports.coverage_bonus(F.col("share")), 4).alias("bonus"))


@register(
    "candidate_pool",
    f"""WITH symbols AS ({A.SYMBOLS_SQL}), q AS ({A.queries_sql(Q)}), e AS ({A.PACKAGE_EDGES_SQL}), imp AS (SELECT DISTINCT a.file_path AS src, b.file_path AS dst FROM e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst),
tk AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))) AS token FROM q),
h AS (SELECT query_id, file_path, count(*) AS hits FROM (SELECT DISTINCT file_path FROM symbols) JOIN tk ON contains(lower(file_path), token) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, file_path) AS r FROM h QUALIFY r <= 10),
few AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top) WHERE n <= 5 AND r <= 3),
m AS (SELECT query_id, id FROM (SELECT query_id, token, id, row_number() OVER (PARTITION BY query_id, token ORDER BY length(name), id) AS r FROM symbols JOIN tk ON contains(lower(name), token)) WHERE r <= 10),
l AS (SELECT query_id, id, 0 AS lane FROM top JOIN symbols USING (file_path) UNION ALL SELECT query_id, id, 1 FROM m
  UNION ALL SELECT query_id, id, 2 FROM (SELECT DISTINCT query_id, src FROM few JOIN imp ON imp.dst = few.file_path) x JOIN symbols ON symbols.file_path = x.src)
SELECT query_id, id, min(lane) AS lane FROM l GROUP BY 1, 2""",
)
def candidate_pool(spark, d):
    s = A.symbols(spark, d)
    a, b = (s.select(F.col("id").alias(k), F.col("file_path").alias(v)) for k, v in (("src", "sf"), ("dst", "df")))
    imports = A.package_edges(spark, d).join(a, "src").join(b, "dst").select(F.col("sf").alias("src"), F.col("df").alias("dst")).distinct()
    return reports.candidate_pool(s, imports, A.queries_frame(spark, Q))


@register(
    "semantic_search",
    f"""WITH {BASE}, {LEX}, {SEM}, dn AS (SELECT query_id, id, score FROM se QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 80),
b AS (SELECT coalesce(dn.query_id, l.query_id) AS query_id, coalesce(dn.id, l.id) AS id,
  round(CASE WHEN dn.score IS NULL THEN l.score / 100 * 0.35 ELSE dn.score + CASE WHEN l.score IS NOT NULL THEN 0.06 ELSE 0 END END, 6) AS score
  FROM dn FULL JOIN (SELECT * FROM lx WHERE rank <= 50) l ON l.query_id = dn.query_id AND l.id = dn.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 20""",
)
def semantic_search(spark, d):
    dense = rank.top_k(vector.scores(A.symbol_vectors(spark, d), A.query_vectors(spark, d)), 80, "score", "id").drop("rank")
    return reports.semantic_search(dense, rank.lexical(A.documents(spark, d), A.queries_frame(spark, Q), 50), 20)


@register(
    "semantic_code_review",
    f"""WITH {_VQ}, c AS (SELECT id AS cid, embedding AS vector FROM v WHERE file_path IN ('f1', 'f2')), s AS (SELECT cid AS id, id AS twin, {cos_sql("embedding", "vector")} AS score FROM v, c WHERE v.id <> cid)
SELECT id, twin, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, twin) <= 3""",
)
def semantic_code_review(spark, d):
    return reports.code_review(A.vectors(spark, d), spark.createDataFrame([("f1",), ("f2",)], "file_path string"))
