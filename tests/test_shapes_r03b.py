"""Shapes that were slow or large in round 3: all pairs by blocks, near items by products, texts and vectors in rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evaluation, lookup, vector
from quarry.sources import buckets, postings


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Copies, ties, structured files, other lengths: what comparing all pairs gives, from several blocks and without codes."""
    monkeypatch.setattr(vector, "PAIR_BLOCK", 60)
    monkeypatch.setattr(vector, "near_pairs", None)
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((150, 6)), 1).astype("float32")
    x[100:130] = x[7]  # more copies than the limit
    data = [(i, "a.json" if i % 10 == 0 else "a.rs", v) for i, v in enumerate(x.tolist())]
    data += [(500, "a.rs", None), (501, "a.rs", [0.0] * 6), (502, "a.rs", [1.0, None]), (503, "a.rs", [1.0, 2.0]), (504, "a.rs", [2.0, 4.0])]
    rows = spark.createDataFrame(data, "id long, file_path string, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    every = [(-round(float(unit[i] @ unit[j]), 6), i, j) for i in range(150) for j in range(i + 1, 150)] + [(-1.0, 503, 504)]
    every = sorted(e for e in every if -e[0] >= (0.95 if e[1] % 10 == 0 or e[2] % 10 == 0 and e[2] < 500 else 0.4))
    for limit in (3, 20, 700):
        got = [(-r.similarity, r.a, r.b) for r in vector.duplicate_pairs(rows, 0.4, limit).collect()]
        assert got == every[:limit]


def test_near_items_are_those_of_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in np.round(rng.standard_normal(5), 1)]) for i in range(300)]
    data += [(400, None), (401, [0.0] * 5), (402, [None] * 5), (403, [1.0]), (404, [float("nan")] * 5)]
    rows = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    asked = rows.where("id % 10 = 0 OR id > 399").selectExpr("cast(id as string) AS query_id", "embedding AS vector")
    key = lambda df: sorted(map(str, df.select("query_id", "id", "score").collect()))
    want = key(vector.scores(rows, asked).where(F.col("score") >= 0.3))
    found = evaluation.near_items(asked, rows, 0.3)
    assert "MapInArrow" in _plan(found) and key(found) == want
    monkeypatch.setattr(vector, "MAX_QUERIES", 20)  # several batches, where one was refused
    assert key(evaluation.near_items(asked, rows, 0.3)) == want


def test_terms_are_counted_in_their_row(spark):
    """Terms of all fields once, as the column expressions count them; postings of new documents are not shuffled."""
    texts = ["a_b cd_ef cd", "CD Über İstanbul ΑΣ x_1y", "", None, "__ a__bc snake_case_name snake", "١٢ ſoft Kelvin 名前 éa"]
    rows = spark.createDataFrame([(i, t, texts[-1 - i], "sig " + (t or "")) for i, t in enumerate(texts)], "id long, name string, name_path string, signature string")
    fields = {"name": 4.0, "signature": 2.5, "body": 1.0}
    made = postings.entries(rows, fields)
    assert "MapInArrow" in _plan(made) and "Exchange" not in _plan(postings._postings(made, False))
    terms = lambda c: T.tokens(F.coalesce(F.col(c), F.lit("")))
    plain = postings.prefix_tokens(F.col("name"), F.col("name_path"), F.col("signature"))
    got = {r.id: r for r in made.collect()}
    for r in rows.select("id", terms("name").alias("n"), terms("signature").alias("s"), plain.alias("w")).collect():
        want = Counter()
        for words, weight in ((r.n, 4.0), (r.s, 2.5)):
            for x in words:
                want[x] += weight
        e = got[r.id]
        assert {(x.term, x.tf) for x in e.bm25} == set(want.items()) and len(e.bm25) == len(want) and e.bm25_dl == sum(want.values())
        assert (e.prefix_dl is None) == (r.w is None) and {(x.term, x.tf) for x in e.prefix} == set(Counter(r.w or []).items())
        assert e.prefix_dl is None or e.prefix_dl == len(r.w)


def test_a_large_bucket_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "FILE_ROWS", 10)
    folder, coalesce = f"file://{tmp_path}/t", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, False)  # so few rows would be put into one task again
    buckets.merge(spark.range(400).withColumn("deleted", F.lit(False)), folder, "id", 0, 2)
    buckets.merge(spark.range(0, 400, 4).withColumn("deleted", F.lit(True)), folder, "id", 1, 2)
    spark.conf.unset(coalesce)
    assert len(list(tmp_path.glob("t/v=0/bucket=0/*.parquet"))) > 1
    assert sorted(r.id for r in buckets.latest(spark, folder).collect()) == [i for i in range(400) if i % 4]


def test_hashed_vectors_take_each_step_once(spark):
    rows = spark.createDataFrame([(1, "a_b ring"), (2, "ring red_bolt red"), (3, ""), (4, None)], "id long, text string")
    found = lookup.hashed_vectors(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the text's tokens were made anew for each of the vector's elements
    for r, t in zip(found.orderBy("id").collect(), rows.orderBy("id").select(F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h")).collect(), strict=True):
        v = np.zeros(64)
        for h in t.h or []:
            v[h % 64] += -1.0 if h < 0 else 1.0
        if t.h is not None:
            assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1.0), atol=1e-6)
