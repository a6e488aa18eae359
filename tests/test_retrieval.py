"""Ranking: what the lanes, weights and priors say about small corpora."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import rank

DOCS = "id long, name string, kind string, signature string, name_path string, file_path string, body string"


def queries(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "ServiceManager", "class", "class ServiceManager:", "ServiceManager", "main.py", ""),
        (2, "run_service", "function", "def run_service():", "run_service", "main.py", ""),
        (3, "helper", "function", "def helper():", "helper", "main.py", "calls service"),
    ]
    return spark.createDataFrame(rows, DOCS)


def found(spark, docs, text, **more):
    return [(r.id, r.match, r.score) for r in rank.hybrid(docs, queries(spark, text), 20, **more).orderBy("rank").collect()]


def test_hybrid_lanes(spark, docs):
    assert found(spark, docs, "ServiceManager", fuzzy=0.7)[0] == (1, "exact", 100.0)
    near = found(spark, docs, "run_service", fuzzy=0.7)
    assert near[0] == (2, "exact", 100.0)
    prefix = {i: m for i, m, _ in found(spark, docs, "service", fuzzy=0.99)}
    assert prefix[2] == "fts" and 3 not in prefix
    assert ("fuzzy" in {m for i, m, _ in found(spark, docs, "helpr", fuzzy=0.7) if i == 3}) and found(spark, docs, "zzz", fuzzy=0.7) == []


def test_hybrid_semantics_and_importance(spark, docs):
    sem = spark.createDataFrame([("q0", 1, 0.5), ("q0", 3, 0.16), ("q0", 2, 0.12)], "query_id string, id long, score double")
    got = {i: (m, s) for i, m, s in found(spark, docs, "run_service", fuzzy=0.99, semantic=sem)}
    assert got == {2: ("exact", 100.0 + 1.8), 1: ("fts", pytest.approx(87.5, abs=1e-5)), 3: ("semantic", 14.4)}
    pr = spark.createDataFrame([("main.py", 0.2), ("b.py", 0.4)], "node string, score double")
    assert found(spark, docs, "run_service", fuzzy=0.99, importance=pr)[0] == (2, "exact", 102.5)


def test_bm25_fields_and_flags(spark):
    rows = [(1, "alpha", "function", "s", "m/alpha", "a.rs", ""), (2, "beta", "function", "s", "m/beta", "b.rs", "alpha"), (3, "alpha", "function", "s", "m/alpha", "t.rs", "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("is_test", F.col("id") == 3).withColumn("exported", F.col("id") == 2)
    q = queries(spark, "alpha")
    plain = [r.id for r in rank.bm25(docs.drop("is_test", "exported"), q).orderBy("rank").collect()]
    assert plain == [1, 3, 2]  # names before bodies
    got = {r.id: r.score for r in rank.bm25(docs, q).collect()}
    base = {r.id: r.score for r in rank.bm25(docs.drop("is_test", "exported"), q).collect()}
    assert got[3] == pytest.approx(base[3] / 2) and got[2] == pytest.approx(base[2] * 1.3) and got[1] == pytest.approx(base[1])
    assert {r.id for r in rank.bm25(docs, q, tests=False).collect()} == {1, 2}
    assert rank.bm25(docs, queries(spark, "")).count() == 0 and rank.bm25(docs.limit(0), q).count() == 0
    # a boosted document below the cut comes up, as scores are adjusted before it
    many = spark.createDataFrame([(i, "alpha", "function", "s", "p", "f", "") for i in range(1, 9)], DOCS).withColumn("exported", F.col("id") == 8)
    assert [r.id for r in rank.bm25(many, q, 1).collect()] == [8]


def test_retriever_prefers_recent_files_and_code(spark):
    rows = [(i, "alpha", "function", "s", "p", f, "") for i, f in ((1, "a/x.rs"), (2, "b/x.rs"), (3, "ci.yml"))]
    docs = spark.createDataFrame(rows, DOCS)
    recent = spark.createDataFrame([("q0", "b/")], "query_id string, prefix string")
    assert [r.id for r in rank.retrieve(docs, queries(spark, "alpha"), 3, recent).orderBy("rank").collect()] == [2, 1, 3]


def test_query_classes_and_weights(spark):
    q = queries(spark, "dispatch_tool", "BackendKind", "gear", "rename symbol", "how does the watcher work", "x" * 31 + "_")
    got = [r[0] for r in q.orderBy("query_id").select(rank.query_class(F.col("query"))).collect()]
    assert got == ["identifier", "identifier", "phrase", "phrase", "sentence", "phrase"]
    row = [("q0", "dispatch_tool", 1, "function", "n", "p", "f.rs", 50.0, 0.0, 1.0, 0.0, None)]
    schema = "query_id string, query string, id long, kind string, name string, name_path string, file_path string, text double, importance double, n double, recency double, semantic double"
    assert rank.blend(spark.createDataFrame(row, schema)).first().score == 32
    rich = [(*row[0][:2], i, *row[0][3:7], 50.0, 0.0, 1.0, 0.0, 0.1 * i) for i in range(1, 6)]
    assert {r.id: r.score for r in rank.blend(spark.createDataFrame(rich, schema)).collect()} == {i: int(32.5 + 4 * i + 1e-9) for i in range(1, 6)}


def test_priors(spark):
    cols = ("query", "kind", "name", "name_path", "file_path")
    rows = [
        ("rename", "function", "f", "f", "x.rs"),  # short: none
        ("find where the file is", "function", "f", "f", "x.rs"), ("find where the file is", "class", "C", "C", "x.rs"), ("find where the file is", "file", "a", "a", "x.rs"),
        ("the http handler", "function", "f", "f", "x.rs"), ("the http handler", "class", "FooError", "F", "x.rs"),
        ("what is this thing called", "function", "test_a", "tests/a", "benchmarks/x.py"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    kind = [r[0] for r in df.select(rank.kind_prior(*[F.col(c) for c in cols])).collect()]
    assert kind == [0, 12, -6, 8, 10 + 6, -8 - 6 + 6, -10]
    path = [r[0] for r in df.select(rank.path_prior(F.col("query"), F.col("file_path"))).collect()]
    assert path == [0, 0, 0, 0, 0, 0, -14]
    rules = [("http", "x.rs", 12.0)]
    assert [r[0] for r in df.select(rank.affinity(F.col("query"), F.col("file_path"), rules)).collect()] == [0, 0, 0, 0, 12, 12, 0]


def test_partial_sort(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(250)] + [("b", i, i) for i in range(200)], "query_id string, id long, score long")
    got = rank.best_of(rows, "score", "id").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {"a": 100, "b": 200}
