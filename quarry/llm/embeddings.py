"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors are one weighted vector from the start, with a number of its own, whatever its ids.  Each
table gives a vector a code of signs; vectors that share a code in some table are compared exactly, in double
precision, tile against tile, and only counts and the edges of a spanning forest leave a task, never pairs.  A
pair that meets in several tables counts in the first of them.  A code with more than ``BLOCK`` vectors is cut
into blocks by hash, and each two of its blocks meet in a task of their own: n vectors of one code cost n^2
comparisons, which exact link counts need, and n^2 / ``BLOCK`` rows to shuffle.

The number of bits grows with the logarithm of the number of vectors, so that a code holds about 64 by
chance, and the number of tables is the least with which a pair at exactly the limit is found with
probability ``RECALL``; closer pairs are found more often.  No pair is found by less than its cosine.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths do not link; pairs at exactly the limit link; rows that repeat an id
count as vectors of their own; a vector with a null id links like any other, and is kept only if no vector
that it reaches has an id; an empty table gives no rows; other columns, labels included, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, written

LIMIT = 0.9
RECALL = 0.97
BUCKET = 64
BLOCK = 1024
#: Vectors whose cosines are worked out at once, squared.
TILE = 1024
SEED = 20_240_601


def plan(n: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 2) / BUCKET)))
    same = (1 - math.acos(limit) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _valid(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(d, lambda x: x != 0), F.lit(False))


def _signer(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.asarray(pa.compute.list_value_length(vectors))
            flat, ends = np.asarray(vectors.flatten()), np.cumsum(sizes)
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), tables * bits))
                at = np.flatnonzero(sizes == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ planes[dim] > 0).reshape(len(at), tables, bits)
                codes[at] = signs @ weights
            out = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, out], ["gid", "w", "v", "codes"])

    return run


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, by edges."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a tile links: each linked row and column to the smallest that it reaches."""
    top = 1 << 60
    la, lb = np.where(near.any(1), a, top), np.where(near.any(0), b, top)
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    u, v = np.concatenate([a, b]), np.concatenate([la, lb])
    real = (v < top) & (u != v)
    return u[real], v[real]


def _compare(table: int, i: int, j: int, block: np.ndarray, ids, w, x, codes):
    """(ids, linked weight, linked id) for one bucket, or for two of its blocks."""
    n = len(ids)
    a, b = (np.flatnonzero(block == i), np.flatnonzero(block == j)) if i != j else (np.arange(n),) * 2
    count = np.zeros(n, np.int64)
    edges = []
    for p in range(0, len(a), TILE):
        for q in range(0 if i != j else p, len(b), TILE):
            at, bt = a[p : p + TILE], b[q : q + TILE]
            near = x[at] @ x[bt].T >= LIMIT
            own = i == j and p == q
            if own:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            edges.append(_forest(near, at, bt))
            r, c = np.nonzero(near)
            if table:
                fresh = np.ones(len(r), bool)
                for k in range(0, len(r), 1 << 17):
                    s = slice(k, k + (1 << 17))
                    fresh[s] = ~(codes[at[r[s]], :table] == codes[bt[c[s]], :table]).any(axis=1)
                r, c = r[fresh], c[fresh]
            np.add.at(count, at[r], w[bt[c]])
            if not own:
                np.add.at(count, bt[c], w[at[r]])
    if not edges:
        return None
    root = _joined(n, *(np.concatenate(e) for e in zip(*edges, strict=True)))
    out = np.flatnonzero((count > 0) | (root != np.arange(n)))
    return ids[out], count[out], ids[root[out]]


def _group_runner(batches):
    """Groups (t, code, i, j) of a sorted partition, one at a time."""
    held: list[pa.RecordBatch] = []
    names = ["gid", "n", "root"]

    def done(part: pa.Table):
        t, i, j = (part.column(c)[0].as_py() for c in ("t", "i", "j"))
        ids = part.column("gid").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, w, block = ids[order], part.column("w").to_numpy()[order], part.column("block").to_numpy()[order]
        col = part.column("v").combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(col))
        flat, ends = np.asarray(col.flatten()), np.cumsum(sizes)
        codes = np.asarray(part.column("codes").combine_chunks().flatten()).reshape(len(ids), -1)[order]
        sizes, ends = sizes[order], ends[order]
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            if len(at) < 2:
                continue
            x = flat[(ends[at] - dim)[:, None] + np.arange(dim)].astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            if found := _compare(t, i, j, block[at], ids[at], w[at], x, codes[at]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    keys = ("t", "code", "i", "j")
    for batch in batches:
        if not batch.num_rows:
            continue
        k = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in k])) + 1
        starts = [0, *cut.tolist(), batch.num_rows]
        for s, e in zip(starts, starts[1:]):
            part = batch.slice(s, e - s)
            if held and any(held[0].column(c)[0] != part.column(c)[0] for c in keys):
                yield from done(pa.Table.from_batches(held))
                held = []
            held.append(part)
    if held:
        yield from done(pa.Table.from_batches(held))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(h1, h2, rep, w, v): valid vectors, equal ones once, with their smallest id and their number."""
    v = F.col("embedding")
    return (
        vectors.where(_valid(v))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            v.alias("v"),
            F.xxhash64(v).alias("h1"),
            F.xxhash64(F.lit(1), v).alias("h2"),
        )
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("v").alias("v"))
    )


def link_counts(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gid, n: weight of the other vectors linked) and spanning edges (gid, root)."""
    n = groups.count()
    bits, tables = plan(n)
    signed = written(
        groups.select("gid", "w", "v").mapInArrow(
            _signer(bits, tables), f"gid long, w long, v {dict(groups.dtypes)['v']}, codes array<long>"
        ),
        "embedding-signs",
    )
    sizes = signed.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > BLOCK).select("t", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("g")), "embedding-large")
    rows = signed.select("gid", "w", "v", "codes", F.posexplode("codes").alias("t", "code"))
    if large.isEmpty():
        rows = rows.select("*", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        rows = rows.join(large, ["t", "code"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("gid"), F.col("g")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        rows = rows.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("g", "o")
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables // 200_000)
    found = written(
        rows.repartition(parts, "t", "code", "i", "j")
        .sortWithinPartitions("t", "code", "i", "j")
        .mapInArrow(_group_runner, "gid long, n long, root long"),
        "embedding-links",
    )
    counts = found.groupBy("gid").agg(F.sum("n").alias("n"))
    return counts, found.where("gid <> root").select("gid", "root").distinct()


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    groups = written(distinct_vectors(vectors).withColumn("gid", F.monotonically_increasing_id()), "embedding-distinct")
    counts, edges = link_counts(groups)
    comps = components(edges, "gid", "root").select(F.col("node").alias("gid"), "component")
    joined = written(
        groups.select("h1", "h2", "gid", "rep", "w").join(counts, "gid", "left").join(comps, "gid", "left"), "embedding-groups"
    )
    least = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(least, "component", "left").select(
        "h1",
        "h2",
        (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("least", "rep").alias("component_id"),
    )
    v = F.col("embedding")
    ok = _valid(v)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(ok, F.xxhash64(v)).alias("h1"),
        F.when(ok, F.xxhash64(F.lit(1), v)).alias("h2"),
    )
    out = rows.join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    alone = F.col("component_id").isNull()
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), alone))


def query(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)


#: All pairs by brute force, for small tables.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS uid, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT uid, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.uid AS a, b.uid AS b, a.vec_id AS ia, b.vec_id AS ib FROM ok a JOIN ok b ON a.uid <> b.uid AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {LIMIT}),
r(a, b, id) AS (SELECT a, b, ib FROM l UNION SELECT r.a, l.b, l.ib FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(id) AS m FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
x AS (SELECT vec_id, coalesce(k.n, 0) AS n_links, least(vec_id, c.m) AS component_id FROM v LEFT JOIN k ON k.a = v.uid LEFT JOIN c ON c.a = v.uid)
SELECT *, coalesce(vec_id = component_id, component_id IS NULL) AS kept FROM x
"""
