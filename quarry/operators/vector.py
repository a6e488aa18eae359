"""Vector retrieval: exact search for a batch of queries, duplicates, classes, misplaced symbols.

Search compares a stated set of queries with every row: queries are sent to the rows (their number is
checked), the best k are kept per task, and nothing is indexed.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators.sizes import batch, small
from quarry.storage import written

#: Query batches up to this number are sent to every task; larger ones are refused.
MAX_QUERIES = 10_000


def knn(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of each query (query_id, vector); 1 - L2 or cosine.

    ``within`` names a column that must agree: candidates are then an equi-join on it.
    """
    if within:
        both = _compared(rows.join(batch(queries, MAX_QUERIES), within), metric)
    else:
        both = _near(rows, queries, lambda sent: _nearest(sent, k, metric), metric)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return both.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """``knn`` for any number of queries, in batches of about half the largest: work is queries times rows, memory a batch's."""
    return _batched(queries, lambda q: knn(rows, q, k, metric))


def reaching(rows: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query_id, id, score): rows with a cosine to a query at or above a limit, for any number of queries, in batches."""
    return _batched(queries, lambda q: _near(rows, q, lambda sent: _reaching(sent, least)).where(F.col("score") >= least))


def _batched(queries: DataFrame, one) -> DataFrame:
    groups = math.ceil(queries.count() / max(1, MAX_QUERIES // 2))
    if groups <= 1:
        return one(queries)
    of = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    return reduce(DataFrame.unionAll, [one(queries.where(of == g)) for g in range(groups)])


def _compared(both: DataFrame, metric: str) -> DataFrame:
    score = T.cosine(F.col("embedding"), F.col("vector"))
    if metric == "l2":
        score = 1 - T.l2(F.col("embedding"), F.col("vector"))
    return both.select("query_id", "id", F.round(score, 6).alias("score"))


def _plain(v: str, size: int) -> Column:
    """Whether a vector has so many numbers, all of them of a size that products keep."""
    fine = lambda x: x.isNotNull() & ((x == 0) | F.abs(x.cast("double")).between(1e-100, 1e100))
    return F.coalesce((F.size(v) == size) & F.forall(v, fine), F.lit(False))


def _near(rows: DataFrame, queries: DataFrame, kept, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score): a superset of the rows that count for each query, with the scores of ``_compared``.

    Plain vectors of the queries' length are multiplied as matrices, of which each task keeps what ``kept`` says; the few
    rows and queries that are odd (nulls, no numbers, other lengths) are compared one by one.
    """
    asked = queries.select("query_id", "vector").limit(MAX_QUERIES + 1).collect()  # a batch, of a checked number
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in a batch")
    rows, kind = rows.select("id", "embedding"), queries.schema["query_id"].dataType.simpleString()
    plain, size = [], 0
    for r in asked:
        v = r.vector
        if v and all(x is not None and (x == 0 or 1e-100 <= abs(x) <= 1e100) for x in v) and len(v) == (size or len(v)):
            plain.append(r)
            size = len(v)
    known = {id(r) for r in plain}
    odd = rows.sparkSession.createDataFrame([tuple(r) for r in asked if id(r) not in known], queries.select("query_id", "vector").schema)
    if not plain:
        return _compared(rows.crossJoin(F.broadcast(odd)), metric)
    same = rows.sparkSession.createDataFrame([tuple(r) for r in plain], queries.select("query_id", "vector").schema)
    fine = _plain("embedding", size)
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.vector for r in plain], np.float64), [r.query_id for r in plain]))
    best = rows.where(fine).withColumn("id", F.col("id").cast("long")).mapInArrow(kept(sent), f"query_id {kind}, id long, score double")
    found = best.select("query_id", F.col("id").cast(rows.schema["id"].dataType).alias("id"), F.round("score", 6).alias("score"))
    found = found.unionAll(_compared(rows.where(~fine).crossJoin(F.broadcast(same)), metric))
    return found.unionAll(_compared(rows.crossJoin(F.broadcast(odd)), metric)) if len(plain) < len(asked) else found


#: Rows and queries whose products a task holds at a time.
ROWS, QUERIES = 2048, 1024


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores in millionths, half up by their decimal digits, as SQL rounds them."""
    scaled = score * 1e6
    out = np.rint(scaled)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return out


def _running_sum(a: np.ndarray) -> np.ndarray:
    """Sums of rows in the order of their elements, bit for bit those of a fold."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j]
    return out


def _nearest(sent, k: int, metric: str):
    """The k best rows of each query in a task: near by products of matrices, then in exact scores and by least id."""

    def run(batches):
        q, names = sent.value
        nq = np.sqrt(_running_sum(q * q))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]  # query, id, score, millionths
        least = np.full(len(q), -np.inf)  # what a row must reach to count

        def exact(x, nx, qi, ri):
            if metric == "l2":
                return 1 - np.sqrt(_running_sum((x[ri] - q[qi]) ** 2))
            under = nx[ri] * nq[qi]
            return np.divide(_running_sum(x[ri] * q[qi]), under, out=np.zeros(len(ri)), where=under > 0)

        def kept(parts):
            qi, ids, score, key = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((ids, -key, qi))
            qi, ids, score, key = qi[order], ids[order], score[order], key[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi)
            full = place == k - 1
            least[qi[full]] = key[full] / 1e6
            return [c[place < k] for c in (qi, ids, score, key)]

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            whole = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            for r in range(0, b.num_rows, ROWS):
                x = whole[r : r + ROWS]
                nx = np.sqrt(_running_sum(x * x))
                for c in range(0, len(q), QUERIES):
                    qs, ns, top = q[c : c + QUERIES], nq[c : c + QUERIES], least[c : c + QUERIES]
                    dot, slack = qs @ x.T, 2e-6
                    if metric == "l2":
                        near = 1 - np.sqrt(np.maximum(ns[:, None] ** 2 + nx[None, :] ** 2 - 2 * dot, 0))
                        slack += 1e-6 * (nx.max() + ns.max())
                    else:
                        under = ns[:, None] * nx[None, :]
                        near = np.divide(dot, under, out=np.zeros_like(dot), where=under > 0)
                    if len(x) > k and not np.isfinite(top).all():
                        top = np.maximum(top, np.partition(near, len(x) - k, axis=1)[:, len(x) - k])
                    qi, ri = np.nonzero(near >= top[:, None] - slack)
                    if len(qi):
                        for s in range(0, len(qi), 1 << 18):
                            a, at = qi[s : s + (1 << 18)] + c, ri[s : s + (1 << 18)]
                            score = exact(x, nx, a, at)
                            best = kept([best, [a, ids[r + at], score, _rounded(score)]])
        for s in range(0, len(best[0]), 10_000):
            qi, ids, score, _ = (c[s : s + 10_000] for c in best)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in qi]), pa.array(ids), pa.array(score)], ["query_id", "id", "score"])

    return run


def _reaching(sent, least: float):
    """The rows of a task with a cosine to a query at or above a limit: near by products of matrices, then in exact scores."""

    def run(batches):
        q, names = sent.value
        nq, names = np.sqrt(_running_sum(q * q)), pa.array(names)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            whole = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
            for r in range(0, b.num_rows, ROWS):
                x = whole[r : r + ROWS]
                nx = np.sqrt(_running_sum(x * x))
                for c in range(0, len(q), QUERIES):
                    under = nq[c : c + QUERIES, None] * nx[None, :]
                    near = np.divide(q[c : c + QUERIES] @ x.T, under, out=np.zeros_like(under), where=under > 0)
                    qi, ri = np.nonzero(near >= least - 2e-6)
                    for s in range(0, len(qi), 1 << 18):
                        a, at = qi[s : s + (1 << 18)] + c, ri[s : s + (1 << 18)]
                        score = np.divide(_running_sum(x[at] * q[a]), nx[at] * nq[a], out=np.zeros(len(at)), where=nx[at] * nq[a] > 0)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), pa.array(ids[r + at]), pa.array(score)], ["query_id", "id", "score"])

    return run


def similar(rows: DataFrame, targets: DataFrame, k: int = 5) -> DataFrame:
    """Nearest rows of given rows, without themselves: oversampled, then cut."""
    q = rows.join(small(targets), "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    near = search(rows, q, k + 8).where("id <> query_id")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): the cosine of every row with every query (query_id, vector) of a batch."""
    both = rows.crossJoin(batch(queries, MAX_QUERIES))  # queries against all rows
    return both.select("query_id", "id", F.round(T.cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))


#: Random planes and tables that bring rows together, as in locality-sensitive hashing.
PLANES_SEED, RECALL, IN_CODE, BLOCK = 11, 0.99, 64, 1024


def plan(n: int, limit: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): a code holds about IN_CODE rows by chance, and a pair at the limit meets with this probability."""
    bits = max(1, math.ceil(math.log2(max(n, 2) / IN_CODE)))
    same = (1 - math.acos(max(-1.0, min(1.0, limit))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _coded(bits: int, tables: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            v = b.column(b.schema.get_field_index("embedding"))
            sizes = np.asarray(pa.compute.list_value_length(v))
            flat, ends = np.asarray(v.flatten(), dtype=np.float64), np.cumsum(sizes)
            codes = np.zeros((b.num_rows, tables), np.int64)
            for d in np.unique(sizes):
                if d not in planes:
                    planes[d] = np.random.default_rng([PLANES_SEED, int(d)]).standard_normal((int(d), tables * bits))
                at = np.flatnonzero(sizes == d)
                x = flat[(ends[at] - d)[:, None] + np.arange(d)]
                codes[at] = (x @ planes[d] > 0).reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "codes"])

    return run


def near_pairs(rows: DataFrame, limit: float, recall: float = RECALL) -> DataFrame:
    """(a, b, similarity): pairs of rows (id, embedding) of any files with a cosine at or above a limit.

    Rows meet in tables of random-plane codes.  A code with more than ``BLOCK`` rows is cut into blocks, each two
    of which are a task's; a pair that meets in several tables counts in the first.
    """
    ok = rows.select("id", "embedding").where(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    )
    n = ok.count()
    bits, tables = plan(n, limit, recall)
    schema = f"id long, embedding {dict(ok.dtypes)['embedding']}, codes array<long>"
    coded = written(ok.withColumn("id", F.col("id").cast("long")).mapInArrow(_coded(bits, tables), schema), "vector-codes")
    met = coded.select("id", "embedding", "codes", F.posexplode("codes").alias("t", "code"))
    large = met.groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g")).where("g > 1")
    met = met.join(large, ["t", "code"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    met = met.select("*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        out = []
        block, i, j, t = frame["block"].to_numpy(), frame["i"].iat[0], frame["j"].iat[0], int(frame["t"].iat[0])
        ids, codes, size = frame["id"].to_numpy(), np.stack(frame["codes"].to_numpy()), frame["embedding"].map(len).to_numpy()
        for d in np.unique(size):
            a, b = np.flatnonzero((block == i) & (size == d)), np.flatnonzero((block == j) & (size == d))
            if not len(a) or not len(b):
                continue
            x = np.stack(frame["embedding"].iloc[np.union1d(a, b)].to_numpy()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            where = {int(r): k for k, r in enumerate(np.union1d(a, b))}
            xa, xb = x[[where[int(r)] for r in a]], x[[where[int(r)] for r in b]]
            sim = np.round(xa @ xb.T, 6)
            p, q = np.nonzero(sim >= limit)
            u, v = ids[a[p]], ids[b[q]]
            keep = (u < v) if i == j else (u != v)
            if t:
                keep &= ~(codes[a[p], :t] == codes[b[q], :t]).any(axis=1)
            out.append(pd.DataFrame({"a": np.minimum(u, v)[keep], "b": np.maximum(u, v)[keep], "similarity": sim[p, q][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64"})

    cols = ["id", "embedding", "codes", "t", "block", "i", "j", "code"]
    return met.select(*cols).groupBy("t", "code", "i", "j").applyInPandas(compare, "a long, b long, similarity double")


#: Rows of a block of which two are a task's, and blocks that there are at least if they would not be tiny.
PAIR_BLOCK, PAIR_BLOCKS = 65_536, 6


def best_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """(a, b, similarity): the pairs of rows (id, embedding, least) that are among the ``limit`` most similar, and others.

    A pair counts from the larger ``least`` of its rows. All pairs are compared, by products of matrices: each two blocks of
    rows are a task's, which keeps its ``limit`` best by similarity and ids. Of rows with one vector only the first
    ``limit`` + 1 by id can be in such a pair: for one with a later row there are ``limit`` of the same similarity before it.
    """
    ok = rows.where(
        F.col("id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    ).select(F.col("id").cast("long").alias("id"), "embedding", "least")
    first = F.row_number().over(Window.partitionBy("embedding", "least").orderBy("id"))
    ok = written(ok.withColumn("first", first).where(F.col("first") <= limit + 1).drop("first"), "vectors-once")
    n = ok.count()
    g = max(1, math.ceil(n / PAIR_BLOCK), min(PAIR_BLOCKS, n // 2048))
    met = ok.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(g)).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    met = met.select("*", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.size("embedding").alias("size")).drop("o")
    return met.groupBy("i", "j", "size").applyInArrow(_best_of_blocks(limit), "a long, b long, similarity double")


def _best_of_blocks(limit: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        ids, block, least = (table.column(c).to_numpy() for c in ("id", "block", "least"))
        i, j, d = (table.column(c)[0].as_py() for c in ("i", "j", "size"))
        x = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(len(ids), d)
        norm = np.concatenate([np.sqrt(_running_sum(x[s : s + ROWS].astype(np.float64) ** 2)) for s in range(0, len(x), ROWS)])
        unit = np.concatenate([(x[s : s + ROWS] / norm[s : s + ROWS, None]).astype(np.float32) for s in range(0, len(x), ROWS)])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        slack = 2e-6 + 2e-7 * d  # what single precision may be off, and the rounding
        best, top = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], -np.inf
        for r in range(0, len(left), ROWS):
            at = left[r : r + ROWS]
            for c in range(r if i == j else 0, len(right), ROWS):
                to = right[c : c + ROWS]
                p, q = np.nonzero(unit[at] @ unit[to].T >= max(top, min(least[at].min(), least[to].min())) - slack)
                for s in range(0, len(p), 1 << 18):
                    u, v = at[p[s : s + (1 << 18)]], to[q[s : s + (1 << 18)]]
                    keep = ids[u] < ids[v] if i == j else ids[u] != ids[v]
                    u, v = u[keep], v[keep]
                    sim = _rounded(_running_sum(x[u].astype(np.float64) * x[v]) / (norm[u] * norm[v])) / 1e6
                    keep = (sim >= top) & (sim >= np.maximum(least[u], least[v]))
                    lower, higher = np.minimum(ids[u], ids[v])[keep], np.maximum(ids[u], ids[v])[keep]
                    best = [np.concatenate(z) for z in zip(best, (lower, higher, sim[keep]), strict=True)]
                    order = np.lexsort((best[1], best[0], -best[2]))[:limit]
                    best = [z[order] for z in best]
                    top = best[2][-1] if len(order) == limit else -np.inf
        return pa.table(dict(zip(("a", "b", "similarity"), best, strict=True)))

    return run


def duplicate_pairs(rows: DataFrame, threshold: float, limit: int, filtered: bool = False, recall: float = RECALL) -> DataFrame:
    """The most similar unordered pairs of rows of all files at or above a threshold, which structured files raise.

    The reference stops at the first pairs that its scan meets; here the best ones are taken, which makes the
    result independent of order: of all pairs, or, ``filtered``, of those that ``near_pairs`` finds.  With ``name``, ``kind`` and ``text`` each pair has its ``reason`` (see ``noise``);
    ``filtered`` keeps those without one.
    """
    if filtered:
        pairs = written(near_pairs(rows, threshold, recall), "vector-pairs")
    else:
        least = T.duplicate_threshold(threshold, F.col("file_path"), F.col("file_path")).cast("double").alias("least")
        pairs = best_pairs(rows.select("id", "embedding", least), limit).orderBy(F.col("similarity").desc(), "a", "b").limit(limit)
        pairs = small(written(pairs, "vector-pairs"))
    more = [c for c in ("name", "kind", "text") if c in rows.columns]
    a = rows.select(F.col("id").alias("a"), F.col("file_path").alias("file_a"), *[F.col(c).alias(f"{c}_a") for c in more])
    b = rows.select(F.col("id").alias("b"), F.col("file_path").alias("file_b"), *[F.col(c).alias(f"{c}_b") for c in more])
    pairs = pairs.join(a, "a").join(b, "b")
    pairs = pairs.where(F.col("similarity") >= T.duplicate_threshold(threshold, F.col("file_a"), F.col("file_b")))
    columns = ["a", "b", "file_a", "file_b", "similarity"]
    if len(more) == 3:
        pairs = pairs.withColumn("jaccard", F.round(T.jaccard(T.body_tokens(F.col("text_a")), T.body_tokens(F.col("text_b"))), 6)).withColumn("reason", noise())
        pairs, columns = pairs.where("reason = 'kept'") if filtered else pairs, [*columns, "jaccard", "reason"]
    return pairs.select(*columns).orderBy(F.col("similarity").desc(), "a", "b").limit(limit)


def file_means(rows: DataFrame) -> DataFrame:
    """Element-wise mean vector of each file: positions are averaged in parallel, then put together."""
    return (
        rows.select("file_path", F.posexplode("embedding").alias("at", "x"))
        .groupBy("file_path", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("file_path")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("embedding"))
    )


def classify(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, category, score): the best category of each row; categories are a small table."""
    both = rows.crossJoin(batch(categories)).select(
        "id", "category", F.round(T.cosine(F.col("embedding"), F.col("vector")), 6).alias("score")
    )
    best = both.groupBy("id").agg(F.max(F.struct(F.col("score"), F.col("category"))).alias("m"))
    return best.select("id", F.col("m.category").alias("category"), F.col("m.score").alias("score"))


def misplaced(rows: DataFrame, limit: int) -> DataFrame:
    """Rows that are least like the rest of their file, by mean cosine; files with one row are left out.

    The mean over the others follows from the sum of the file's unit vectors, so that a file's rows are
    never paired: cost grows with rows, not with their square.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = rows.withColumn("unit", F.transform("embedding", lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))
    sums = (
        unit.select("file_path", F.posexplode("unit").alias("at", "x"))
        .groupBy("file_path", "at")
        .agg(F.sum("x").alias("s"))
        .groupBy("file_path")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda v: v["s"]).alias("total"))
    )
    counts = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dot = F.aggregate(F.zip_with("unit", "total", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x)
    scored = unit.join(counts, "file_path").join(sums, "file_path").select(
        "id", "file_path", F.round((dot - own) / (F.col("n") - 1), 6).alias("avg_similarity")
    )
    order = F.round(F.col("avg_similarity") + T.role_boost(F.col("file_path")), 6)
    return scored.orderBy(order, "id").limit(limit)


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """What an index run has to do per (symbol, text) key: reuse, embed or delete."""
    both = old.select("key", F.lit(True).alias("had")).join(new.select("key", F.lit(True).alias("has")), "key", "full")
    action = F.when(F.col("had").isNull(), "embed").when(F.col("has").isNull(), "delete").otherwise("reuse")
    return both.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def least_recent(cache: DataFrame, keep: int) -> DataFrame:
    """Query-cache rows that go: all but the ``keep`` most recently used."""
    recent = cache.orderBy(F.col("last_used").desc(), F.col("hits").desc(), "cache_key").limit(keep)
    return cache.join(recent.select("cache_key"), "cache_key", "left_anti")


def semantic_rerank(scored: DataFrame, weight: float = 0.75) -> DataFrame:
    """Blends a vector score with the share of query tokens that the symbol's texts contain."""
    toks = F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)
    text = F.lower(F.concat_ws(" ", "name", T.split_identifier(F.col("name")), "name_path", "signature", "file_path"))
    overlap = F.size(F.filter(toks, lambda t: F.contains(text, t))) / F.greatest(F.size(toks), F.lit(1))
    return scored.withColumn("score", F.round(F.col("score") * weight + overlap * (1 - weight), 8))


# Keys of configuration files that say nothing about shared code, kinds that hold data, and file types of code.
CONFIG_KEYS = (
    "name", "on", "env", "jobs", "job", "steps", "step", "uses", "with", "run", "needs", "permissions", "strategy", "matrix",
    "workflow_dispatch", "push", "pull_request", "schedule", "branches", "paths", "timeout_minutes", "runs_on",
)
DATA_KINDS = ("variable", "constant", "const", "field", "property", "parameter", "static", "local")
SIGNATURE_ONLY = (0.85, 0.5)


def noise() -> Column:
    """Why a pair (file_a, file_b, name_a, name_b, kind_a, kind_b, similarity, jaccard) is no duplicate worth showing; else kept."""
    a, b = (T.extension(F.col(c)).isin(*T.STRUCTURED_TYPES) for c in ("file_a", "file_b"))
    key = F.replace(F.lower(F.when(a, F.col("name_a")).otherwise(F.col("name_b"))), F.lit("-"), F.lit("_")).isin(*CONFIG_KEYS)
    here, same = F.col("file_a") == F.col("file_b"), F.col("name_a") == F.col("name_b")
    data = F.col("kind_a").isin(*DATA_KINDS) & F.col("kind_b").isin(*DATA_KINDS)
    shape = (F.col("similarity") >= SIGNATURE_ONLY[0]) & (F.col("jaccard") < SIGNATURE_ONLY[1])
    return (
        F.when(a & b, "config_config")
        .when((a | b) & key, "config_code")
        .when(here & same, "same_symbol")
        .when(here & data, "same_file_data")
        .when(shape, "signature_only")
        .otherwise("kept")
    )
