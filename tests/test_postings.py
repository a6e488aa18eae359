import pytest
from pyspark.sql import functions as F

from quarry.operators import rank
from quarry.sources import postings
from quarry.storage import new_folder

SCHEMA = "id long, name string, name_path string, signature string, file_path string, body string, is_test boolean, is_generated boolean, exported boolean"
WORDS = ["ring", "bolt", "gear", "small_ring", "parse", "Rang", "über", "x9", "the"]


def row(i, salt=0):
    w = [WORDS[(i * 7 + k * 3 + salt) % len(WORDS)] for k in range(5)]
    return (i, w[0], f"{w[1]}/{w[0]}", f"fn {w[0]}({w[2]})", f"src/{w[3]}.rs", " ".join(w * (i % 4)), i % 5 == 0, i % 7 == 0, i % 3 == 0)


QUERIES = [("q1", "small ring"), ("q2", "bolt"), ("q3", "über parse gear"), ("q4", "nothing"), ("q5", "r")]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id string, query string")


def same(spark, folder, docs, queries):
    """Rows from the index equal those of tokenising all documents."""
    key = lambda df: sorted(tuple(r) for r in df.collect())
    for kinds in ({}, {"tests": False, "generated": False}):
        want = key(rank.bm25(docs, queries, 8, **kinds))
        assert key(rank.bm25_indexed(spark, folder, queries, 8, **kinds)) == want and want
    assert key(rank.fts_prefix_indexed(spark, folder, queries, 8)) == key(rank.fts_prefix(docs, queries, 8))
    assert key(rank.retrieve(docs, queries, 3, folder=folder)) == key(rank.retrieve(docs, queries, 3))


def test_scores_over_changes_equal_those_of_a_scan(spark, queries):
    folder = new_folder(spark, "index")
    now = {i: row(i) for i in range(60)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    postings.merge(frame(now.values()), folder, 0, rank.FIELD_WEIGHTS)
    same(spark, folder, frame(now.values()), queries)
    changed = {3: row(3, 2), 4: row(4, 5), 100: row(100)}
    for _ in range(2):  # a version that is written again is the same
        postings.merge(frame(changed.values()), folder, 1, rank.FIELD_WEIGHTS, spark.createDataFrame([(7,), (8,), (999,)], "id long"))
    now = {k: v for k, v in (now | changed).items() if k not in (7, 8)}
    same(spark, folder, frame(now.values()), queries)
    delta = spark.read.parquet(f"{folder}/postings/v=1")
    assert {r.id for r in delta.select("id").distinct().collect()} == {3, 4, 7, 8, 100}
    postings.compact(spark, folder, 2)
    same(spark, folder, frame(now.values()), queries)
    assert spark.read.parquet(f"{folder}/postings").agg(F.min("v")).first()[0] == 2
    postings.merge(frame([row(200)]), folder, 3, rank.FIELD_WEIGHTS)
    same(spark, folder, frame([*now.values(), row(200)]), queries)


def test_a_query_reads_the_folders_of_its_terms(spark):
    folder = new_folder(spark, "index")
    postings.merge(spark.createDataFrame([row(i) for i in range(40)], SCHEMA), folder, 0, rank.FIELD_WEIGHTS)
    plan = postings.read(spark, folder, "bm25", ["bolt", "gear"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "lead" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term, [bolt,gear])" in plan
    assert "StringStartsWith(term,ri)" in postings.read(spark, folder, "prefix", ["ri"], prefix=True)._jdf.queryExecution().executedPlan().toString()


def test_empty_index(spark, queries):
    folder = new_folder(spark, "index")
    postings.merge(spark.createDataFrame([], SCHEMA), folder, 0, rank.FIELD_WEIGHTS)
    assert rank.bm25_indexed(spark, folder, queries).count() == 0 and rank.fts_prefix_indexed(spark, folder, queries).count() == 0
