import numpy as np
import pytest

from quarry.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def brute(rows):
    n = len(rows)
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    near = [[i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9 for j in range(n)] for i in range(n)]
    label = [r[0] for r in rows]
    while True:
        new = [min([label[i]] + [label[j] for j in range(n) if near[i][j]]) for i in range(n)]
        if new == label:
            return [(rows[i][0], sum(near[i]), label[i], label[i] == rows[i][0]) for i in range(n)]
        label = new


def clusters(seed, groups, size, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, 16))
    out = []
    for c in centres:
        for _ in range(size):
            out.append((c * rng.uniform(0.1, 9) + noise * np.linalg.norm(c) * rng.standard_normal(16) / 4).astype("float32").tolist())
    return out


@pytest.mark.parametrize("block, tile", [(embeddings.BLOCK, embeddings.TILE), (8, 3), (1000, 5)])
def test_links_and_components(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "RECALL", 0.9999)
    vectors = clusters(1, 12, 14, 0.25) + [[1.0] + [0.0] * 15] * 9
    rows = [(1000 - i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in embeddings.query(df).collect())
    want = sorted(brute(rows))
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= there and found >= 0.99 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [r[2] for r in got] == [r[2] for r in want]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in embeddings.query(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[7] == [(3, 7, True)] and got[8] == [(3, 7, False)] and got[10] == [(3, 7, False)] * 2
    assert embeddings.query(df.limit(0)).count() == 0


def test_more_vectors_get_more_bits_and_tables():
    assert embeddings.plan(100)[0] < embeddings.plan(10**6)[0] < embeddings.plan(10**9)[0]
    assert embeddings.plan(10**4)[1] < embeddings.plan(10**7)[1]


def test_vectors_without_an_id_link(spark):
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (None, None), (None, [-1.0, 0.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = sorted((tuple(r) for r in embeddings.query(df).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 1, None, True), (None, 1, None, True),
                          (None, 0, None, True), (None, 0, None, True)], key=str)


def test_recall_with_production_parameters(spark):
    """Pairs with cosines from 0.9 up, most of them near it, among unrelated vectors; brute force has them all."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 32))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.9 + 0.1 * rng.random((3000, 1)) ** 2
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * side]).astype("float32").astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    there = (unit @ unit.T >= embeddings.LIMIT).sum(1) - 1
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(x.tolist())], SCHEMA)
    got = {r.vec_id: r.n_links for r in embeddings.query(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(there))
    assert sum(got.values()) >= 0.97 * there.sum() and there.sum() >= 5900
