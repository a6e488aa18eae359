from pyspark.sql import functions as F

from quarry.operators import vector
from quarry.plans import retrieval
from quarry.sources import buckets, vectors

SF = "/root/testdata/sf0.001"


def test_store_follows_a_project_and_embeds_only_what_is_new(spark, tmp_path):
    folder, asked = f"file://{tmp_path}/store", []
    rows = lambda *x: spark.createDataFrame(list(x), "id long, file_path string, text string")

    def embed(new):
        asked.append({r.text for r in new.collect()})
        return new.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))

    held = lambda: {r.id: (r.file_path, list(r.embedding)) for r in vectors.rows(spark, folder).collect()}
    assert held() == {}
    first = rows((1, "a", "x"), (2, "a", "yy"), (3, "b", None), (4, "c", "zzzz"), (4, "c", "zzzz"), (None, "c", "w"))
    assert vectors.reconcile(first, folder, 0, embed, 4) == {"embed": 4}
    assert held() == {1: ("a", [1, 1]), 2: ("a", [2, 1]), 3: ("b", [0, 1]), 4: ("c", [4, 1])}
    second = rows((1, "a", "x"), (2, "a", "yyy"), (3, "moved", ""), (5, "n", "new"))
    for _ in range(2):  # a version that is run again gives the same
        assert vectors.reconcile(second, folder, 1, embed, 4) == {"reuse": 1, "embed": 2, "move": 1, "delete": 1}
        assert held() == {1: ("a", [1, 1]), 2: ("a", [3, 1]), 3: ("moved", [0, 1]), 5: ("n", [3, 1])}
    assert all(a <= {"yyy", "new"} for a in asked[1:])
    vectors.delete_files(spark.createDataFrame([("a",), ("none",)], "file_path string"), folder, 2, 4)
    buckets.compact(spark, folder, 3, "id")
    assert set(held()) == {3, 5} and vectors.reconcile(second.limit(0), folder, 4, embed, 4) == {"delete": 2} and held() == {}


def test_query_equals_plain_rows_and_search_reads_the_store(spark):
    got = {r.id: r.embedding for r in retrieval.vector_store(spark, SF).collect()}
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()} & set(table)
    want = {i: [-x for x in table[i]] if i % 3 == 0 or i % 7 == 0 else list(table[i]) for i in ids if i % 5}
    assert got.keys() == want.keys() and all([float(x) for x in got[i]] == [float(x) for x in want[i]] for i in got)
    store = retrieval.vector_store(spark, SF)
    best = vector.knn(store, store.where("id = 1").select(F.lit("q").alias("query_id"), F.col("embedding").alias("vector")), 1).first()
    assert (best.id, best.score) == (1, 1.0)
