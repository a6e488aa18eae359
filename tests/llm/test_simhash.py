import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash


def slow_fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints():
    for t in (None, "", " \n", "one", "One TWO", "a b c", "Éa b c d\x0be f g", "x y z " * 500):
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("limit", [64, 1])
def test_components_match_brute_force(spark, limit):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    fps = set(seeds)
    for s in seeds:
        x = s
        for _ in range(5):
            for _ in range(rnd.choice([1, 2, 3])):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    linked = simhash.links(df.select("fp"), max_bucket=limit).collect()
    assert all(((r.a ^ r.b) & simhash._M64).bit_count() <= 2 for r in linked)
    want = groups(fps)
    least = {}
    for i, f in enumerate(fps):
        least.setdefault(want[f], i)
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    assert got == {i: least[want[f]] for i, f in enumerate(fps)}


def test_query_defined_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(5, None), (3, ""), (9, "  "), (7, long), (2, long), (2, long), (8, "other words are here"), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = simhash.query(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in got) == [(-1, 2), (2, 2), (2, 2), (3, 3), (5, 3), (7, 2), (8, 8), (9, 3)]
    assert {r.fingerprint for r in got if r.component_id == 3} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [2, 3, 8]
    assert simhash.query(docs.limit(0)).count() == 0


def test_keep_one_goes_by_row_and_not_by_id(spark, tmp_path):
    one, two = "a first text with words of its own " * 3, "quite another story is told by this one " * 4
    rows = [(1, one, 5), (1, two, 6), (1, one, 5), (None, "no id and no copy of it anywhere here", 7), (None, two, 8), (4, None, 9), (3, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    want = sorted([(1, one), (1, two), (None, rows[3][1]), (3, "")], key=str)
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str) == want
    docs.repartition(3).write.parquet(f"{tmp_path}/docs.parquet")
    kept = simhash.keep_one(spark.read.parquet(f"{tmp_path}/docs.parquet"))
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    assert {r.row for r in kept.where("doc_id = 1").collect()} == {5, 6}
    assert simhash.keep_one(docs.limit(0)).count() == 0
