"""Shapes that failed in round 4: questions on an index of occurrences, and what they leave on disk."""

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import navigation

OCC = "file string, ordinal int, symbol string, start_line int, end_line int, definition boolean"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _known(spark, *symbols):
    return spark.createDataFrame([(s, []) for s in symbols], "symbol string, docs array<string>")


def _asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, name string, file string, line int")


def _shuffled(spark, run) -> int:
    """Rows that ``run`` writes to shuffles."""
    sc = spark.sparkContext
    group = f"shuffled-r04-{id(run)}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    written = 0
    for s in {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}:
        try:
            written += sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords()
        except Py4JJavaError as e:  # a stage that was skipped, which Spark forgets first
            if "NoSuchElementException" not in str(e.java_exception):
                raise
    return written


def _index(spark):
    """Names with one and with several symbols in a file, known and not, defined and not."""
    rows = [
        ("a.rs", "x a/one().", 1, True), ("a.rs", "x a/two().", 2, True), ("a.rs", "x b/two().", 5, False), ("a.rs", "x b/two().", 6, False),
        ("a.rs", "x a/two().", 6, False), ("a.rs", "x std/out().", 7, False), ("b.rs", "x b/two().", 3, True), ("b.rs", "x b/one().", 4, True),
        ("b.rs", "x c/far().", 8, False), ("b.rs", "x b/out().", 9, True),
    ]
    occ = spark.createDataFrame([(f, i, s, n, n, d) for i, (f, s, n, d) in enumerate(rows)], OCC)
    return occ, _known(spark, "x a/one().", "x b/two().", "x d/far().")


QUESTIONS = [
    ("sole", "one", "a.rs", 99), ("place", "two", "a.rs", 5), ("first", "two", "a.rs", 6), ("elsewhere in the file", "two", "a.rs", 77), ("wide", "one", "z.rs", 1),
    ("external", "out", "a.rs", 7), ("no known one", "out", "z.rs", 7), ("unknown", "far", "z.rs", 1), ("none", "zzz", "z.rs", 1), ("null", None, "a.rs", 1), ("no file", "two", None, 5),
    ("same", "one", "a.rs", 1), ("same", "one", "b.rs", 1),
]


def test_references_by_place_file_and_name(spark):
    occ, known = _index(spark)
    got = sorted(tuple(r) for r in navigation.references(occ, known, _asked(spark, *QUESTIONS)).collect())
    two = [("x b/two().", "a.rs", 5, "reference", 0.8), ("x b/two().", "a.rs", 6, "reference", 0.8), ("x b/two().", "b.rs", 3, "definition", 1.0)]
    one = ("x a/one().", "a.rs", 1, "definition", 1.0)
    out = ("x std/out().", "a.rs", 7, "reference")
    want = [("sole", *one), ("wide", *one), ("same", *one), ("same", "x b/one().", "b.rs", 4, "definition", 1.0)]
    want += [(q, *r) for q in ("place", "first", "elsewhere in the file", "no file") for r in two]
    want += [("external", *out, 0.8), ("no known one", *out, 0.7), ("no known one", "x b/out().", "b.rs", 9, "reference", 0.7)]
    want += [("unknown", "x c/far().", "b.rs", 8, "reference", 0.7)]
    assert got == sorted(want)


def test_occurrences_of_references_are_not_broadcast(spark, tmp_path):
    """Symbols that are a few bytes as a file: the planner took all occurrences for small, and sent them through the driver."""
    n = 2000
    rows = spark.range(n).selectExpr("concat('f', id % 20) AS file", "cast(id AS int) AS ordinal", "concat('x f', id % 40, '/same().') AS symbol", "cast(id AS int) AS start_line", "id < 40 AS definition")
    rows.write.parquet(f"{tmp_path}/occ")
    occ = spark.read.parquet(f"{tmp_path}/occ")
    known = occ.select("symbol", F.array().cast("array<string>").alias("docs")).distinct()
    found = navigation.references(occ, known, _asked(spark, ("all", "same", "", 0), ("none", "other", "", 0)))
    assert "Broadcast" not in _plan(found)
    assert found.count() == n and {(r.kind, r.score) for r in found.collect()} == {("definition", 1.0), ("reference", 0.8)}


def test_definitions_by_place_file_and_name(spark):
    occ, known = _index(spark)
    got = sorted((r.query_id, r.symbol, r.file, r.line, r.score) for r in navigation.definitions(occ, known, _asked(spark, *QUESTIONS)).collect())
    one = ("x a/one().", "a.rs", 1, 1.0)
    want = [("sole", *one), ("wide", *one), ("same", *one), ("same", "x b/one().", "b.rs", 4, 1.0)]
    want += [(q, "x b/two().", "b.rs", 3, 1.0) for q in ("place", "first", "elsewhere in the file", "no file")]
    want += [("external", "x b/out().", "b.rs", 9, 0.9), ("no known one", "x b/out().", "b.rs", 9, 0.9)]  # no definition of far
    assert got == sorted(want)


def test_questions_are_shuffled_twice(spark):
    """By name and file, and by what they ask for: they had been shuffled six times, with all that an index has of places."""
    n = 6000
    occ = spark.range(n).selectExpr(
        "concat('f', id % 5, '.rs') AS file", "cast(id AS int) AS ordinal", "concat('x f', id % 5, '/n', id % 20, '().') AS symbol", "cast(id AS int) AS start_line",
        "cast(id AS int) AS end_line", "id < 20 AS definition",
    )
    known = occ.select("symbol", F.array().cast("array<string>").alias("docs")).distinct()
    asked = occ.selectExpr("concat(file, ':', start_line) AS query_id", "concat('n', ordinal % 20) AS name", "file", "start_line AS line")
    got = []
    assert _shuffled(spark, lambda: got.extend(navigation.definitions(occ, known, asked).collect())) < 3 * n
    assert len({r.query_id for r in got}) == len(got) == n and {r.score for r in got} == {1.0}


def test_shuffles_of_a_written_step_go(spark):
    jvm, key = spark._jvm, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    every = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    files = lambda: {f for f in every() if f.startswith("shuffle_") and f.endswith(".data")}
    was, before = spark.conf.get(key), files()
    rows = spark.range(1000).repartition(4, "id")
    made = storage.written(rows, "test-freed", free=True)
    for _ in range(100):  # blocks are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key) == was
    assert made.count() == rows.count() == 1000  # what was written can still be computed
