"""Shapes that failed or were slow in round 3: joins of texts that look small, the index of occurrences, tokens of programs."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import calls, modules, navigation, rank
from quarry.sources import scip


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled(spark, df) -> int:
    """Rows that a collect of ``df`` writes to shuffles."""
    sc = spark.sparkContext
    group = f"shuffled-c-{id(df)}"
    sc.setJobGroup(group, group)
    df.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_candidates_of_imports_are_not_broadcast(spark):
    """Files made from a few bytes: the planner takes all sides for small, and sent the candidates whole."""
    files = spark.range(50).selectExpr("id", "concat('web/f', id, '.ts') AS relative_path", "concat('import { a } from \"./f', id + 1, '\";') AS content")
    found = modules.resolve(modules.extract(files), files)
    bound = calls.bind(calls.module_clauses(files), found)
    assert "BroadcastHashJoin" not in _plan(found) and "BroadcastHashJoin" not in _plan(bound)
    want = {(f"web/f{i}.ts", f"web/f{i + 1}.ts" if i < 49 else None) for i in range(50)}
    assert {(r.relative_path, r.target) for r in found.collect()} == want
    assert {(r.file, r.target) for r in bound.where("local = 'a'").collect()} == want


def test_normal_paths(spark):
    paths = ["a/b", "a//b", "/a", "a/", "", ".", "..", "a/./b", "a/../b", "../a", "a/..", "a/.b", "a/..b", "a./b", "a/...", None]
    got = [r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select(modules.normal(F.col("p")).alias("n")).collect()]
    assert got == ["a/b", "a/b", "a", "a", "", "", "", "a/b", "b", "a", "", "a/.b", "a/..b", "a./b", "a/...", None]


def test_definitions_of_a_name_meet_questions_last(spark):
    """Questions and definitions of one name: their product is the result, and nothing shuffles it."""
    n = 300
    occ = spark.range(n).selectExpr(
        "concat('f', id) AS file", "explode(array(0, 1)) AS ordinal", "concat('q f', id, '/same().') AS symbol", "ordinal * 5 AS start_line", "0 AS start_col",
        "ordinal * 5 AS end_line", "4 AS end_col", "ordinal = 0 AS definition",
    )
    known = occ.select("symbol", F.array().cast("array<string>").alias("docs")).distinct()
    asked = spark.range(n).selectExpr("concat('q', id) AS query_id", "'same' AS name", "'elsewhere' AS file", "1 AS line")
    found = navigation.definitions(occ, known, asked)
    assert found.count() == n * n and "BroadcastHashJoin" not in _plan(found)
    assert _shuffled(spark, found) < n * n // 10
    one = asked.where("query_id = 'q7'").withColumn("file", F.lit("f9")).unionAll(asked.where("query_id = 'q8'").withColumn("name", F.lit("none")))
    assert [tuple(r) for r in navigation.definitions(occ, known, one).collect()] == [("q7", "q f9/same().", "f9", 0, None, 1.0)]
    bare = navigation.definitions(occ, known.limit(0), asked.limit(1)).collect()  # no known symbol: by name
    assert len(bare) == n and {r.score for r in bare} == {0.9}


def test_documents_are_encoded_by_columns(tmp_path, monkeypatch):
    """Fields in any order, numbers of several bytes, documents cut from a batch; occurrences are no dictionaries."""
    occ = [
        {"start_line": i * 40, "start_col": 3, "symbol": f"s{i % 2}", "end_line": i * 40 + i % 2, "end_col": 200 * (i % 3), "roles": i % 2,
         "docs": ["a", "é"] if i % 4 == 1 else [], "diagnostics": [{"code": "E", "message": "m", "severity": 3}] if i == 5 else []}
        for i in range(9)
    ]
    docs = [{"path": f"p{k}", "language": "rs", "occurrences": occ[k:], "symbols": [{"symbol": "s", "docs": ["x"], "display_name": "d"}]} for k in range(3)]
    batch = pa.RecordBatch.from_pylist(docs)
    held = []
    monkeypatch.setattr(scip, "encode", lambda d, real=scip.encode: held.append(d["occurrences"]) or real(d))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    list(scip._writer(f"file://{tmp_path}/x")(iter([batch])))
    assert len(held) == 3 and not any(isinstance(x, list) for x in held)
    data, got = (tmp_path / "x" / "part-00000.scip").read_bytes(), []
    for _, value in scip._fields(data):
        got.append(scip._document(value))
    assert got == docs


def test_documents_of_a_hybrid_search_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"name_{i % 4}", f"f{i}.rs", "n", "s", "b") for i in range(40)], "id long, name string, file_path string, name_path string, signature string, body string")
    queries = spark.createDataFrame([("q", "name_1")], "query_id string, query string")
    importance = docs.selectExpr("file_path AS node", "id / 100.0D AS score")
    plans = []
    monkeypatch.setattr(rank, "written", lambda df, name: plans.append(_plan(df)) or df)
    got = rank.hybrid(docs, queries, 5, importance=importance).collect()
    whole = next(p for p in plans if "jaro" in p or "like" in p)
    for key in ("name", "id", "file_path"):
        assert re.search(rf"SortMergeJoin \[{key}#", whole), key
    assert [r.id for r in got] == [37, 33, 29, 25, 21]
