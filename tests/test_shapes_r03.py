"""Shapes that failed in round 3: rows without optional columns, and plans that must not send what grows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import adapters as A
from quarry.operators import edits, lookup, reports, vector
from quarry.sources import scip, scripts
from quarry.streaming import ingest


def test_leases_without_a_mark_are_live_until_their_time(spark):
    rows = spark.createDataFrame([(1, 5), (2, 50)], "session int, expires_at long")
    assert [r.session for r in ingest.live(rows, 10).collect()] == [2]
    marked = spark.createDataFrame([(1, 50, None), (2, 50, True), (3, 50, False)], "session int, expires_at long, expired boolean")
    assert sorted(r.session for r in ingest.live(marked, 10).collect()) == [1, 3]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wrappers_and_lines_are_not_sent_to_every_task(spark):
    files = spark.range(3).selectExpr("id", "'fn a(x) { b(x) }\\na(1)' AS content")
    wrappers = spark.range(3).selectExpr("id", "1L AS line_no", "'a' AS name", "'b' AS target")
    found = edits.inline(files, wrappers)
    assert "Broadcast" not in _plan(found)
    assert sorted((r.id, r.line_no, r.action, r.after) for r in found.collect()) == [
        x for i in range(3) for x in ((i, 1, "remove", ""), (i, 2, "replace", "b(1)"))
    ]


@pytest.mark.parametrize("made", [A.sources, A.programs, A.scripts, A.documents])
def test_texts_made_from_parts_are_work_for_several_tasks(spark, made):
    rows = made(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() > 1 and rows.where("length(" + rows.columns[-2] + ") > 0").rdd.getNumPartitions() > 1


def test_names_of_many_small_scripts_come_in_few_frames():
    frames = list(scripts._walked(iter([pd.DataFrame({"file_path": [f"{i}.js" for i in range(500)], "mask": ["let a = 1;\na;"] * 500})])))
    assert len(frames) == 1 and len(frames[0]) == 1000 and frames[0]["file_path"].nunique() == 500


def test_the_best_rows_are_those_of_one_by_one(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in np.round(rng.standard_normal(8), 1)]) for i in range(300)]
    data += [(1000 + i, data[i % 5][1]) for i in range(200)]  # copies, so that ties are broken by id
    data += [(2000, None), (2001, [0.0] * 8), (2002, [None] + [1.0] * 7), (2003, [1.0]), (2004, [float("nan")] * 8), (2005, [1e-200] * 8)]
    rows = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    asked = rows.where("id % 50 = 0 OR id > 1999").selectExpr("id AS query_id", "embedding AS vector")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    for metric in ("cosine", "l2"):
        plain = vector._compared(rows.crossJoin(asked), metric).withColumn("rank", F.row_number().over(by).cast("long")).where("rank <= 7")
        key = lambda df: sorted(map(str, df.select("query_id", "id", "score", "rank").collect()))
        found = vector.knn(rows, asked, 7, metric)
        assert "BatchEvalPython" not in _plan(found) and "MapInArrow" in _plan(found)
        assert key(found) == key(plain)


def test_equal_ranges_meet_once(spark):
    n = 3000  # of two ranges only: pairs of symbols would be millions
    rows = spark.range(n).selectExpr("'f' AS file_path", "id", "10 - 10 * (id % 2) AS start_byte", "20 + 10 * (id % 2) AS end_byte")
    found = lookup.nested(rows)
    assert found.where("id % 2 = 0 AND parent_id = 1").count() == n // 2 and found.where("id % 2 = 1 AND parent_id IS NULL").count() == n // 2


def test_a_document_at_a_time_is_python_objects(spark, tmp_path, monkeypatch):
    held = []
    monkeypatch.setattr(scip, "encode", lambda d, real=scip.encode: held.append(d) or real(d))
    batch = pa.RecordBatch.from_pylist([{"path": f"{i}", "language": "", "occurrences": [], "symbols": []} for i in range(5)], scip._DOCUMENT)
    sizes = []

    class Watched:
        num_rows = 5

        def slice(self, i, n):
            sizes.append(n)
            return batch.slice(i, n)

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    assert [b.column(0)[0].as_py() for b in scip._writer(f"file://{tmp_path}/x")(iter([Watched()]))] == [5]
    assert sizes == [1] * 5 and len(held) == 5


def test_queries_beyond_a_batch_are_searched_in_several(spark, monkeypatch):
    rows = spark.range(40).selectExpr("id", "array(sin(id), cos(id), 1.0D) AS embedding")
    whole = vector.similar(rows, rows.select("id"), 3).collect()
    monkeypatch.setattr(vector, "MAX_QUERIES", 20)
    assert len(whole) == 120 and sorted(map(str, vector.similar(rows, rows.select("id"), 3).collect())) == sorted(map(str, whole))


def _shuffled(spark, df) -> int:
    """Rows that a collect of ``df`` writes to shuffles."""
    sc = spark.sparkContext
    group = f"shuffled-{id(df)}"
    sc.setJobGroup(group, group)
    df.collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store, n = sc._jsc.sc().statusStore(), 0
    for s in stages:
        n += store.lastStageAttempt(s).shuffleWriteRecords()
    return n


def test_importers_are_counted_once_a_file(spark):
    """Names of one file have its importers: no row a name and importer; a name of two files has those of both, once."""
    symbols = spark.createDataFrame([(f"n{f}_{k}", f"f{f}") for f in range(2) for k in range(200)] + [("both", "f0"), ("both", "f1")], "name string, file_path string")
    imports = spark.createDataFrame([(f"s{i}", f"f{f}") for f in range(2) for i in range(f * 50, 150)] + [("f0", "f0")], "src string, dst string")
    calls = spark.createDataFrame([("a", "n0_1"), ("b", "n0_1"), ("b", "n0_1")], "caller_name string, callee_name string")
    found = edits.safe_delete(calls, symbols, imports)
    rows = {r.name: (r.callers, r.importers, r.safe) for r in found.collect()}
    assert rows["n0_1"] == (2, 150, False) and rows["n1_7"] == (0, 100, False) and rows["both"] == (0, 150, False) and len(rows) == 401
    assert 0 < _shuffled(spark, edits.safe_delete(calls, symbols, imports)) < 10_000


def test_occurrences_at_gives_each_once(spark):
    occ = [("a", 1, "x", "reference"), ("a", 1, "x", "reference"), ("b", 2, "x", "definition"), ("b", 2, "x", "definition"), ("a", 1, "y", "reference"), ("c", 3, "y", "definition")]
    index = spark.createDataFrame(occ, "file string, line long, symbol string, role string")
    at = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x")], "file string, line long, symbol string")
    assert [tuple(r) for r in reports.occurrences_at(index, at).collect()] == [("a", 1, "x", "b", 2)]
    assert sorted(tuple(r) for r in reports.occurrences_at(index, at.select("file", "line")).collect()) == [("a", 1, "x", "b", 2), ("a", 1, "y", "c", 3)]
