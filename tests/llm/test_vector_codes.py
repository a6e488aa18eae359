import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quarry.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=2, scale=256):
    """All distances in Python's numbers: (vec_id, code, error, label), and the text of the codebooks."""
    ok = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(ok[0][1]) if ok else 0
    ok = [r for r in ok if len(r[1]) == dim]
    width = -(-dim // 16)
    whole = [[math.floor(float(np.float32(c)) * scale) for c in r[1]] + [0] * (16 * width - dim) for r in ok]
    parts = [[w[p * width : (p + 1) * width] for p in range(16)] for w in whole]
    books = [[list(x[p]) for x in parts[:64]] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(16):
            sums = {}
            for x in parts:
                sums.setdefault(nearest(p, x[p])[1], []).append(x[p])
            new.append([[sum(c) // len(sums[i]) for c in zip(*sums[i])] if i in sums else e for i, e in enumerate(books[p])])
        books = new
    out = []
    for r, x in zip(ok, parts):
        found = [nearest(p, x[p]) for p in range(16)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
    return out, ",".join(str(c) for b in books for e in b for c in e)


def check(spark, rows, schema=SCHEMA):
    got = vc.query(spark.createDataFrame(rows, schema).repartition(3)).collect()
    want, text = brute(rows)
    total = {}
    for _, _, e, label in want:
        total[label] = total.get(label, 0) + e
    sort = lambda x: sorted(x, key=repr)
    assert sort((r.vec_id, r.code, r.error, r.label_error) for r in got) == sort((i, c, e, total[la]) for i, c, e, la in want)
    assert {r.codebooks_sha256 for r in got} <= {hashlib.sha256(text.encode()).hexdigest()}
    return got


def vectors(n, dim=32, seed=1):
    g = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in g.normal(0, 0.2, dim)], None if i % 3 == 0 else i % 5) for i in range(n)]


def test_brute_force(spark):
    check(spark, vectors(300))


def test_ties_repeats_nulls_and_lengths(spark):
    rows = vectors(90, 16)
    rows += [(3, rows[3][1], 1)] * 5 + [(3, rows[4][1], 2), (None, rows[5][1], None)]
    rows += [(200, None, 1), (201, [0.1] * 15 + [None], 1), (202, [0.1] * 15 + [float("nan")], 1), (203, [float("inf")] * 16, 1), (204, [], 1), (205, [0.5] * 32, 1)]
    rows += [(300 + i, [float(i % 2)] * 16, 9) for i in range(50)]
    check(spark, rows)


def test_few_vectors_and_other_lengths(spark):
    check(spark, vectors(5, 20))
    check(spark, [(1, [0.5] * 3, None)])


def test_large_components_are_exact(spark):
    rows = vectors(80, 16)
    rows[70] = (70, [1e6, -1e6, 3e7] + [0.25] * 13, 1)
    check(spark, rows)


def test_error_beyond_a_long_is_null(spark):
    rows = vectors(80, 16)
    rows[70] = (70, [3e38] * 8 + [-3e38] * 8, 1)
    rows[71] = (71, [2e38] * 8 + [-1e38] * 8, 1)
    rows = [(i, v, 1) for i, v, _ in rows] + [(i + 100, v, 2) for i, v, _ in rows[70:72]]
    assert len(vc.query(spark.createDataFrame(rows, SCHEMA)).collect()) == 82


def test_empty_table(spark):
    assert vc.query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vc.query(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame(vectors(70), SCHEMA)
    more = df.withColumns({c: F.lit("x") for c in ("v", "code", "error", "label_error", "part")})
    assert sorted(vc.query(more).collect()) == sorted(vc.query(df).collect())


def test_bounds_hold_and_prune():
    """The lower bound is never above, the upper never below the distance, and most entries are not compared."""
    g = np.random.default_rng(3)
    book, x = g.integers(-200, 200, (64, 4)), g.integers(-250, 250, (3000, 4))
    cells = vc.Cells(book)
    lower, upper = cells.bounds(x)
    exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, error, compared = cells.nearest(x)
    assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    assert compared < 0.35 * exact.size


def test_sql(spark):
    rows = vectors(150, 32)
    rows += [(900, None, 1), (901, [float("nan")] * 32, 1)]
    got = vc.query(spark.createDataFrame(rows, SCHEMA))
    import pyarrow as pa

    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(vc.ORACLE_SQL).fetchall())
