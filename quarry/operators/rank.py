"""Retrieval and ranking: BM25F, lexical score, blends, hybrid lanes, reciprocal-rank fusion, budgets.

Every operator takes a batch of queries, so that the corpus is tokenised and counted once for all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.functions.udfs import jaro_winkler
from quarry.operators.sizes import batch, small
from quarry.sources import postings as index
from quarry.storage import written

# Field weights, BM25 and fusion constants.
FIELD_WEIGHTS = {
    "name_path": 5.0, "name": 4.0, "signature": 2.5, "module_path": 2.0, "file_path": 1.5, "doc_comment": 1.5, "body": 1.0,
}
K1, B = 1.2, 0.75
TEST_WEIGHT, GENERATED_WEIGHT, EXPORTED_WEIGHT = 0.5, 0.5, 1.3
COORDINATION, COORDINATION_BONUS = 0.8, 1.1
RECENT_BONUS = 1.08
RRF_K = 60
LANES = {"structural": 1.0, "semantic": 1.0, "sparse": 0.8, "user": 0.6}
IDENTIFIER_LANES = LANES | {"semantic": 0.6, "sparse": 1.0}
SENTENCE_LANES = LANES | {"semantic": 1.2, "sparse": 0.6}
#: words in a query, at least -> entries that the semantic and the sparse lane may bring.
LANE_CAPS = ((4, 6, 4), (2, 2, 3), (0, 3, 2))


def postings(docs: DataFrame, asked: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(id, dl, hits): each document's weighted length, and its weighted frequency of the terms that are asked for.

    Both are worked out in the document's row: no token leaves it but those asked for.
    """
    terms = asked.select("term").distinct().agg(F.collect_list("term").alias("terms"))  # a batch of queries

    def of_fields(x: Column) -> Column:
        length = sum((F.size(x[f]) * w for f, w in fields.items()), F.lit(0.0))
        here = F.array_intersect(F.flatten(F.array(*[x[f] for f in fields])), x["terms"])

        def frequency(t: Column) -> Column:
            return sum((F.size(F.filter(x[f], lambda y: y == t)) * w for f, w in fields.items()), F.lit(0.0))

        return F.struct(length.alias("dl"), F.transform(here, lambda t: F.struct(t.alias("term"), frequency(t).alias("tf"))).alias("hits"))

    parts = F.struct(*[T.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields], F.col("terms"))
    return docs.crossJoin(F.broadcast(terms)).select("id", T.let(parts, of_fields).alias("p")).select("id", "p.dl", "p.hits")  # one row


def bm25(
    docs: DataFrame, queries: DataFrame, k: int = 10, fields: dict[str, float] | None = None, tests: bool = True, generated: bool = True
) -> DataFrame:
    """Top k documents of each query by fielded BM25.

    Document count, frequencies and mean length are over all documents.  The corpus is tokenised once, into a
    narrow table of lengths and of the asked terms; scores are summed map-side before they are shuffled.
    Documents with is_test, is_generated or exported count less or more before the cut, and tests and generated
    ones are left out after scoring unless they are asked for.
    """
    have = {f: w for f, w in (fields or FIELD_WEIGHTS).items() if f in docs.columns}
    asked = _asked_terms(queries)
    flags = [c for c in ("is_test", "is_generated", "exported") if c in docs.columns]
    rows = written(postings(docs, asked, have), "bm25")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = rows.select("id", "dl", F.explode("hits").alias("h")).select("id", "dl", "h.term", "h.tf")
    return _bm25_top(hits, stats, asked, k, docs.select("id", *flags) if flags else None, tests, generated)


def _asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))


def bm25_indexed(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, tests: bool = True, generated: bool = True) -> DataFrame:
    """What ``bm25`` returns, from an index (``sources.postings``): the postings of the queries' terms are read, and no text."""
    asked = _asked_terms(queries)
    terms = [r.term for r in asked.select("term").distinct().collect()]  # a batch of queries
    hits = written(index.read(spark, folder, "bm25", terms), "bm25-hits")  # read for document frequencies, and for scores
    flags = hits.select("id", *index.FLAGS).distinct()
    return _bm25_top(hits.drop(*index.FLAGS), index.statistics(spark, folder, "bm25"), asked, k, flags, tests, generated)


def _bm25_top(hits: DataFrame, stats: DataFrame, asked: DataFrame, k: int, flagged: DataFrame | None, tests: bool, generated: bool) -> DataFrame:
    """Top k of (id, dl, term, tf), given (n, avgdl) of all documents and the flags of documents."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    count = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    scored = (
        hits.join(small(df), "term")
        .join(small(asked), "term")
        .crossJoin(F.broadcast(stats))  # one row
        .groupBy("query_id", "id")
        .agg(F.sum(idf * tf).alias("score"), F.count(F.lit(1)).alias("matched"))
        .join(small(count), "query_id")
    )
    bonus = F.when(F.col("matched") / F.col("n_terms") >= COORDINATION, COORDINATION_BONUS).otherwise(1.0)
    if flagged is not None:
        scored = scored.join(flagged, "id")
        for flag, weight, wanted in (("is_test", TEST_WEIGHT, tests), ("is_generated", GENERATED_WEIGHT, generated), ("exported", EXPORTED_WEIGHT, True)):
            if flag in flagged.columns:
                bonus = bonus * F.when(F.col(flag), weight).otherwise(1.0)
                scored = scored if wanted else scored.where(~F.coalesce(F.col(flag), F.lit(False)))
    # equal documents tie, in whatever order their terms were summed
    scored = scored.withColumn("score", F.round(F.col("score") * bonus, 9))
    return top_k(scored, k, "score", "id").select("query_id", "id", "score", "matched", "rank")


def retrieve(
    docs: DataFrame, queries: DataFrame, k: int, recent: DataFrame | None = None, tests: bool = False, generated: bool = False, folder: str | None = None
) -> DataFrame:
    """Top k by BM25 of five times as many, after configuration files have lost and recent files (query_id, prefix) have gained.

    ``folder`` has an index of the documents; without one they are tokenised.
    """
    if folder is None:
        hits = bm25(docs, queries, 5 * k, tests=tests, generated=generated).drop("rank")
    else:
        hits = bm25_indexed(docs.sparkSession, folder, queries, 5 * k, tests, generated).drop("rank")
    rows = hits.join(docs.select("id", "file_path"), "id").join(batch(queries), "query_id")
    rows = rows.withColumn("score", F.col("score") * T.markup_penalty(F.col("file_path"), F.col("query")))
    if recent is not None:
        near = rows.join(small(recent), "query_id").where(F.col("file_path").startswith(F.col("prefix"))).select("query_id", "id").distinct()
        rows = rows.join(near.withColumn("near", F.lit(True)), ["query_id", "id"], "left")
        rows = rows.withColumn("score", F.col("score") * F.when(F.col("near"), RECENT_BONUS).otherwise(1.0))
    rows = rows.withColumn("score", F.round("score", 9))
    return top_k(rows, k, "score", "id").select("query_id", "id", "score", "matched", "rank")


def top_k(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """Adds ``rank`` and keeps the first k of each query; the first order column is descending."""
    by = Window.partitionBy("query_id").orderBy(F.col(order[0]).desc(), *order[1:])
    return rows.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def best_of(rows: DataFrame, *order: str, most: int = 100) -> DataFrame:
    """Ranked rows; of a query with more than twice ``most`` the first ``most``, else all."""
    rows = top_k(rows, 2 * most + 1, *order)
    full = rows.where(F.col("rank") > 2 * most).select("query_id", F.lit(True).alias("full"))
    return rows.join(full, "query_id", "left").where(F.col("full").isNull() | (F.col("rank") <= most)).drop("full")


def fts_prefix(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Documents with a token that starts with a query token, by BM25 over such prefixes; ``score`` is its negative.

    A prefix counts as one term: its frequency is the number of tokens that start with it, and rare terms weigh
    log((N - n + 0.5) / (n + 0.5)), a millionth at least.
    """
    asked = _asked_prefixes(queries)
    prefixes = asked.select("prefix").distinct().agg(F.collect_list("prefix").alias("prefixes"))  # a batch of queries

    def of_tokens(x: Column) -> Column:
        counted = F.transform(
            x["prefixes"], lambda p: F.struct(p.alias("prefix"), F.size(F.filter(x["t"], lambda t: t.startswith(p))).alias("tf"))
        )
        return F.struct(F.size(x["t"]).alias("dl"), F.filter(counted, lambda c: c["tf"] > 0).alias("hits"))

    both = F.struct(index.prefix_tokens(F.col("name"), F.col("name_path"), F.col("signature")).alias("t"), F.col("prefixes"))
    rows = docs.crossJoin(F.broadcast(prefixes)).select("id", T.let(both, of_tokens).alias("p")).select("id", "p.dl", "p.hits")  # one row
    rows = written(rows, "fts")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = rows.select("id", "dl", F.explode("hits").alias("h")).select("id", "dl", "h.prefix", "h.tf")
    return _prefix_top(hits, stats, asked, k)


def _asked_prefixes(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.filter(F.split(F.lower("query"), r"[\s_-]+"), lambda x: x != "")).alias("prefix")).distinct()


def fts_prefix_indexed(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """What ``fts_prefix`` returns, from an index: the postings of terms with the queries' prefixes are read, and no text."""
    asked = _asked_prefixes(queries)
    prefixes = [r.prefix for r in asked.select("prefix").distinct().collect()]  # a batch of queries
    found = index.read(spark, folder, "prefix", prefixes, prefix=True)
    mine = F.filter(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.col("term").startswith(p))
    hits = found.select("id", "dl", "tf", F.explode(mine).alias("prefix")).groupBy("id", "prefix").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return _prefix_top(written(hits, "fts-hits"), index.statistics(spark, folder, "prefix"), asked, k)


def _prefix_top(hits: DataFrame, stats: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    df = hits.groupBy("prefix").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = (
        hits.join(small(df), "prefix")
        .join(small(asked), "prefix")
        .crossJoin(F.broadcast(stats))  # one row
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(idf * tf), 9).alias("score"))
    )
    return top_k(scored, k, "score", "id")


def lexical_score(query: Column, name: Column, signature: Column, name_path: Column, path: Column, kind: Column):
    """The ladder: exact 100, in the name 60, signature 30, name path 20, snake forms, then token shares."""
    q, n, s, np_, p = (F.lower(x) for x in (query, name, signature, name_path, path))
    sq = T.snake(query)
    toks = F.filter(F.split(q, r"[\s_-]+"), lambda t: F.length(t) >= 2)
    total = F.greatest(F.size(toks), F.lit(1)).cast("double")

    def share(where: Column) -> Column:
        return F.size(F.filter(toks, lambda t: F.contains(where, t))) / total

    name_r, sig_r, path_r = share(n), share(s), share(p)
    verb = F.exists(toks, lambda t: t.isin(*T.VERBS))
    bonus = (
        F.when(kind.isin("function", "method") & verb, 8)
        .when(kind.isin("class", "interface", "enum") & ~verb, 5)
        .otherwise(0)
    )
    by_tokens = (
        F.when(name_r > 0, F.least((15 + 40 * name_r).cast("int") + (5 * sig_r).cast("int"), F.lit(55)) + bonus)
        .when(sig_r > 0, (5 + 20 * sig_r).cast("int") + bonus)
        .when(path_r > 0, F.greatest(1 + 4 * path_r, F.lit(1.0)).cast("int") + bonus)
    )
    return (
        F.when(n == q, 100)
        .when(F.contains(n, q), 60)
        .when(F.contains(s, q), 30)
        .when(F.contains(np_, q), 20)
        .when(n == sq, 80)
        .when(F.contains(sq, n) & F.contains(n, F.lit("_")), 70)
        .when(F.contains(n, sq) & F.contains(sq, F.lit("_")), 65)
        .otherwise(by_tokens)
        .cast("long")
    )


def lexical(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top k of each query by the ladder."""
    c = F.col
    rows = docs.crossJoin(batch(queries)).select(  # a stated query set against all rows
        "query_id", "id", lexical_score(c("query"), c("name"), c("signature"), c("name_path"), c("file_path"), c("kind")).alias("score")
    )
    return top_k(rows.where("score IS NOT NULL"), k, "score", "id")


# Query class -> weights of text, importance, recency and semantic signals; rich where vectors have five hits or more.
WEIGHTS = {
    "identifier_rich": (0.65, 0.10, 0.05, 0.20),
    "identifier": (0.65, 0.10, 0.05, 0.10),
    "sentence_rich": (0.20, 0.05, 0.05, 0.70),
    "sentence": (0.60, 0.20, 0.10, 0.10),
    "phrase_rich": (0.50, 0.10, 0.10, 0.30),
    "phrase": (0.60, 0.15, 0.10, 0.15),
}
RICH = 5
# Words of a query that ask for action, entry points, implementations, files; what kinds and paths then gain or lose.
ACTIONS = (
    "rename", "find", "search", "inline", "start", "read", "parse", "build", "watch", "extract", "route", "change", "move",
    "apply", "categorize", "get", "skip",
)
FILES = ("file", "files", "project structure", "key files")
IMPLEMENTATIONS = ("implementation", "handler", "helper", "entrypoint", "primary", "responsible")
ACTION_PRIOR = {
    "function": 12.0, "method": 12.0, "module": 8.0, "class": -6.0, "interface": -6.0, "enum": -6.0, "type_alias": -6.0,
    "variable": -2.0, "property": -2.0,
}
ENTRY_PRIOR = {"function": 10.0, "method": 10.0, "class": -8.0, "interface": -8.0, "enum": -8.0, "type_alias": -8.0}
ROLE_PRIOR = {"core": 6.0, "tool": -4.0, "infrastructure": -2.0, "surface": -8.0, "test": -12.0, "benchmark": -14.0}


def _words(query: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))


def is_identifier(query: Column) -> Column:
    """One word of at most 30 characters with an underscore or a capital."""
    return (_words(query) == 1) & query.rlike(r"_|\p{Lu}") & (F.octet_length(query) <= 30)


def query_class(query: Column) -> Column:
    return F.when(is_identifier(query), "identifier").when(_words(query) >= 4, "sentence").otherwise("phrase")


def _by(table: dict[str, float], key: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), table.items(), F).otherwise(0.0)


def _mentions(query: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(query, F.lit(w)), words, F.lit(False))


def asks_entry(q: Column) -> Column:
    return _mentions(q, ("entrypoint", " handler", "primary implementation")) | q.startswith("handler ")


def kind_prior(query: Column, kind: Column, name: Column, name_path: Column, path: Column) -> Column:
    """What a symbol's kind and owner count for, for sentences and questions for entry points; else nothing."""
    q = F.lower(query)
    entry = asks_entry(q)
    file = F.when(kind == "file", F.when(_mentions(q, FILES), 8.0).otherwise(-4.0)).otherwise(0.0)
    prior = (
        F.when(_mentions(q, ACTIONS), _by(ACTION_PRIOR, kind) + file).otherwise(0.0)
        + F.when(entry, _by(ENTRY_PRIOR, kind) + F.when(name.rlike("(Edit|Result|Error)$"), -6.0).otherwise(0.0)).otherwise(0.0)
        + F.when(name.startswith("test_") | name_path.startswith("tests/"), -10.0).otherwise(0.0)
        + F.when(_mentions(q, IMPLEMENTATIONS), _by(ROLE_PRIOR, T.provenance(path))).otherwise(0.0)
    )
    return F.when((_words(query) >= 4) | entry, prior).otherwise(0.0)


def path_prior(query: Column, path: Column) -> Column:
    """What a path counts for, for sentences and questions for entry points; else nothing."""
    prior = F.when(path.rlike("^(benchmarks|models|docs)/"), -14.0).otherwise(0.0) + F.when(path.rlike(r"/tests|_tests\.rs$"), -8.0).otherwise(0.0)
    return F.when((_words(query) >= 4) | asks_entry(F.lower(query)), prior).otherwise(0.0)


def affinity(query: Column, path: Column, rules: list[tuple[str, str, float]]) -> Column:
    """Points for paths with a fragment, for queries with a word: a project's own rules (word, fragment, points)."""
    q = F.lower(query)
    return sum((F.when(F.contains(q, F.lit(w)) & F.contains(path, F.lit(p)), x).otherwise(0.0) for w, p, x in rules), F.lit(0.0))


def semantic_range(queries: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, n_semantic, best): how many vectors a query has met, and the best score, a hundredth at least."""
    per = semantic.groupBy("query_id").agg(F.count("semantic").alias("n_semantic"), F.max("semantic").alias("best"))
    per = queries.select("query_id").join(small(per), "query_id", "left")
    return per.select("query_id", F.coalesce("n_semantic", F.lit(0)).alias("n_semantic"), F.greatest(F.coalesce("best", F.lit(0.01)), F.lit(0.01)).alias("best"))


#: Semantic score from which a row without any text score is kept.
GATE = 0.08


def blend(rows: DataFrame, rules: list[tuple[str, str, float]] | None = None, per: DataFrame | None = None) -> DataFrame:
    """Final score of (query_id, query, id, kind, name, name_path, file_path, text, importance, recency, semantic): gated, weighted, truncated.

    ``n`` is the number of files that importance was computed over; a null ``semantic`` means no vector. Semantic
    scores are relative to the best of their query, and how many there are decides the weights; where ``rows`` are
    gated already, ``per`` (``semantic_range``) has both.
    """
    per = semantic_range(rows.select("query_id").distinct(), rows) if per is None else per
    semantic = F.coalesce("semantic", F.lit(0.0))
    shape = F.when(F.col("n_semantic") >= RICH, F.concat(query_class(F.col("query")), F.lit("_rich"))).otherwise(query_class(F.col("query")))
    gated = rows.join(small(per), "query_id").where((F.col("text") > 0) | (semantic >= GATE)).withColumn("class", shape)
    w = [_by({k: v[i] for k, v in WEIGHTS.items()}, F.col("class")) for i in range(4)]
    score = (
        F.col("text") * w[0]
        + F.least(F.col("importance") * 100 * F.col("n"), F.lit(100.0)) * w[1]
        + F.least(F.col("recency") * 100, F.lit(100.0)) * w[2]
        + F.when(F.col("n_semantic") > 0, F.least(semantic / F.col("best") * 100, F.lit(100.0))).otherwise(0.0) * w[3]
        + kind_prior(F.col("query"), F.col("kind"), F.col("name"), F.col("name_path"), F.col("file_path"))
        + path_prior(F.col("query"), F.col("file_path"))
        + affinity(F.col("query"), F.col("file_path"), rules or [])
    )
    return gated.withColumn("score", F.greatest(F.round(score, 9).cast("int"), F.lit(1)).cast("long")).drop("best", "n_semantic")


def lane_weights(query: Column, lane: str, adaptive: bool) -> Column:
    if not adaptive:
        return F.lit(LANES[lane])
    return (
        F.when(is_identifier(query), IDENTIFIER_LANES[lane]).when(_words(query) >= 4, SENTENCE_LANES[lane]).otherwise(LANES[lane])
    )


def lane_cap(query: Column, lane: str) -> Column:
    """How many entries a lane may bring, by the number of words of the query; null for no limit."""
    at = {"semantic": 1, "sparse": 2}.get(lane)
    if at is None:
        return F.lit(None).cast("int")
    return reduce(lambda acc, row: acc.when(_words(query) >= row[0], row[at]), LANE_CAPS, F)


def fuse(lanes: dict[str, DataFrame], queries: DataFrame, files: DataFrame | None = None, adaptive: bool = False) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lanes (query_id, key, rank), rescaled to 1..100 over all that is fused.

    The semantic and the sparse lane are capped by the shape of the query.  ``files`` (query_id, key, rank) raises
    entries of recent files, at most the first five, and brings none of its own.
    """
    q = batch(queries.select("query_id", "query"))

    def part(lane: str, df: DataFrame) -> DataFrame:
        rows = df.select("query_id", "key", "rank").join(q, "query_id")
        rows = rows.where(lane_cap(F.col("query"), lane).isNull() | (F.col("rank") <= lane_cap(F.col("query"), lane)))
        return rows.select("query_id", "key", (lane_weights(F.col("query"), lane, adaptive) / (RRF_K + F.col("rank"))).alias("part"))

    rows = reduce(DataFrame.unionByName, [part(lane, df) for lane, df in lanes.items()])
    if files is not None:
        raised = part("user", files.where(F.col("rank") <= 5)).join(rows.select("query_id", "key").distinct(), ["query_id", "key"], "left_semi")
        rows = rows.unionByName(raised)
    fused = written(rows.groupBy("query_id", "key").agg(F.round(F.sum("part"), 12).alias("rrf")), "fused")  # read for its range, and for the result
    return top_k(rescale(fused, "rrf"), 1 << 30, "rrf", "key")


def evidence(lane: DataFrame, final: DataFrame, limit: int = 5) -> DataFrame:
    """The first rows of a lane (query_id, key, rank), whether the final list has them, and at which rank."""
    have = final.select("query_id", "key", F.col("rank").alias("final_rank"))
    rows = lane.where(F.col("rank") <= limit).join(have, ["query_id", "key"], "left")
    return rows.select("query_id", "key", "rank", F.col("final_rank").isNotNull().alias("selected"), "final_rank")


def rescale(rows: DataFrame, score: str) -> DataFrame:
    """Adds ``relevance``: a query's scores spread over 1..100, 100 where they do not differ."""
    per = rows.groupBy("query_id").agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    rows = rows.join(small(per), "query_id")
    at = F.round((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * 99 + 1)
    differ = F.col("_high") - F.col("_low") > 1e-9
    return rows.withColumn("relevance", F.when(differ, at).otherwise(F.lit(100.0)).cast("long")).drop("_low", "_high")


def diverse(rows: DataFrame, k: int, per_file: int = 3) -> DataFrame:
    """If a query has more than k results: those beyond the first of each file go last, then k are kept.

    Only the first ``per_file`` of each file, and the first k of all others, can be among them: both are cut
    before they are dealt by query.
    """
    order = [F.col("score").desc(), F.col("id")]
    count = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    in_file = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(*order))
    rows = rows.withColumn("in_file", in_file).join(small(count), "query_id")
    late = F.when((F.col("_n") > k) & (F.col("in_file") > per_file), 1).otherwise(0)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy("late", *order))
    return rows.withColumn("late", late).withColumn("rank", final.cast("long")).where(F.col("rank") <= k).drop("_n", "in_file", "late")


def budget(rows: DataFrame, size: str, limit: int) -> DataFrame:
    """The prefix of each query's ranked rows that fits; the first always does."""
    by = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(size).over(by)
    return rows.withColumn("used", used.cast("long")).where((F.col("rank") == 1) | (F.col("used") <= limit))


# What semantic scores must reach to raise a hit, or to be one, and what importance adds at most.
SEMANTIC_BOOST, SEMANTIC_NEW, IMPORTANCE_BOOST = 0.10, 0.15, 5.0


def hybrid(
    docs: DataFrame, queries: DataFrame, k: int = 30, fuzzy: float = 0.6, semantic: DataFrame | None = None, importance: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """Names that are the query, then prefix hits, names like it, and nearest vectors; one row a symbol, diverse by file.

    ``semantic`` (query_id, id, score) raises what other lanes found and adds the rest; ``importance`` (node: a
    file, score) raises by up to 5.  Names are compared once, however many symbols share them.  Joins with all
    documents are merges, as those may be many times what they are made from, and the planner would send them whole.
    """
    exact = docs.join(small(queries), F.col("name") == F.col("query")).select("query_id", "id", F.lit(100.0).alias("score"), F.lit(0).alias("lane"))
    exact = top_k(exact, k, "score", "id").drop("rank")
    by_prefix = fts_prefix(docs, queries, k) if folder is None else fts_prefix_indexed(docs.sparkSession, folder, queries, k)
    hits = by_prefix.select(
        "query_id", "id", F.greatest(80.0 + F.greatest(-F.col("score"), F.lit(-40.0)), F.lit(40.0)).alias("score"), F.lit(1).alias("lane")
    )
    asked = queries.select("query_id", F.lower("query").alias("ql"))
    names = docs.select("name").distinct().join(batch(asked), F.contains(F.lower("name"), F.substring("ql", 1, 2)))
    like = names.withColumn("like", jaro_winkler(F.lower("name"), F.col("ql"))).where(F.col("like") >= fuzzy)
    fuzzy_hits = docs.hint("merge").join(like, "name").select("query_id", "id", (F.col("like") * 100).alias("score"), F.lit(2).alias("lane"))
    lanes = [exact, hits, fuzzy_hits]
    if semantic is not None:
        new = semantic.where(F.col("score") > SEMANTIC_NEW)
        lanes.append(new.select("query_id", "id", (F.col("score") * 90).alias("score"), F.lit(3).alias("lane")))
    rows = reduce(DataFrame.unionByName, lanes).groupBy("query_id", "id").agg(F.min_by("score", "lane").alias("score"), F.min("lane").alias("lane"))
    if semantic is not None:
        near = semantic.where(F.col("score") > SEMANTIC_BOOST).select("query_id", "id", F.least(F.col("score") * 15, F.lit(10.0)).alias("more"))
        rows = rows.join(near, ["query_id", "id"], "left")
        rows = rows.withColumn("score", F.col("score") + F.when(F.col("lane") < 3, F.coalesce("more", F.lit(0.0))).otherwise(0.0)).drop("more")
    rows = rows.hint("merge").join(docs.select("id", "file_path"), "id")
    if importance is not None:
        top = importance.agg(F.max("score").alias("top"))
        rows = rows.hint("merge").join(importance.select(F.col("node").alias("file_path"), F.col("score").alias("pr")), "file_path", "left").crossJoin(F.broadcast(top))  # one row
        boost = F.when(F.col("top") > 0, F.col("pr") / F.col("top") * IMPORTANCE_BOOST)
        rows = rows.withColumn("score", F.col("score") + F.coalesce(boost, F.lit(0.0))).drop("pr", "top")
    names = F.array(*[F.lit(x) for x in ("exact", "fts", "fuzzy", "semantic")])
    rows = rows.withColumn("score", F.round("score", 9)).withColumn("match", F.get(names, F.col("lane"))).drop("lane")
    return diverse(written(rows, "hybrid"), k)  # read for its size, and for the result


def user_lane(files: DataFrame) -> DataFrame:
    """Recent files (query_id, position, similarity) by half recency, half similarity."""
    recency = F.lit(1.0) - 0.15 * F.col("position")
    return files.withColumn("score", 0.5 * recency + 0.5 * F.col("similarity"))
