"""SimHash near-duplicate groups with a pigeonring candidate filter.

The 64 bits form a ring of five segments.  If two fingerprints differ in at most 2 bits, then from
some segment on every chain of l consecutive segments holds at most floor(2 l / 5) of the differences:
0, 0, 1, 1, 2.  The first two zeros make an equi-join key of two neighbouring segments (25 or 26 bits),
the later budgets drop candidates before the full comparison.

Exact copies share a fingerprint and are one row from then on.  A key with at most ``max_bucket``
fingerprints is compared pair by pair.  In a larger one each fingerprint is written with itself and with
each one-bit change of its free bits: fingerprints at distance 1 or 2 meet in at least one such value,
and all that meet there are within 2 bits, so that each links to the smallest.  That is linear in the
size of the key, at most 41 rows a fingerprint, exact, and keys spread evenly.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts of
one or two words are one shingle; very long texts are counted in stretches of 65,536 shingles; a bit that
exactly half the hashes have is 0; an empty table gives no rows; repeated rows come back as often; extra
columns are ignored.  The component id is the smallest doc_id reachable, and null if all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, located, written

SEGMENTS = (13, 13, 13, 13, 12)
MAX_DIFF = 2
MAX_BUCKET = 64
_SHIFTS = tuple(sum(SEGMENTS[:i]) for i in range(len(SEGMENTS)))
_M64 = (1 << 64) - 1


def shingle_hashes(text: str | None, k: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the ASCII-lower-cased text, repeats included."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if n < k:
        return np.array([digest(joined, 42)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
    start = np.empty(n, np.int64)
    start[0], start[1:] = 0, end[:-1] + 1
    spans = zip(start[: n - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n - k + 1)


def fingerprint(text: str | None) -> int:
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # a very long text in bounded memory
        part = h[at : at + 65536]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _batches(batches):
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
        names = b.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, long columns ``also``, fp long): one Arrow pass over the whole texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, "text")
    schema = ", ".join(f"{c} long" for c in rows.columns[:-1])
    return rows.mapInArrow(_batches, f"{schema}, fp long")


def _seg(x: Column, i: int) -> Column:
    i %= len(SEGMENTS)
    return F.shiftrightunsigned(x, _SHIFTS[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1))


def _chain(a: Column, b: Column, start: int) -> Column:
    """Whether the differences stay within budget along the chain from a segment on."""
    x, total, ok = a.bitwiseXOR(b), None, None
    for n in range(1, len(SEGMENTS) + 1):
        d = F.bit_count(_seg(x, start + n - 1))
        total = d if total is None else total + d
        within = total <= MAX_DIFF * n // len(SEGMENTS)
        ok = within if ok is None else ok & within
    return ok


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within MAX_DIFF bits."""
    m = len(SEGMENTS)
    fp = F.col("fp")
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.lit(i << 32)
                    + _seg(fp, i) * (1 << SEGMENTS[(i + 1) % m])
                    + _seg(fp, i + 1)
                    for i in range(m)
                ]
            )
        ).alias("k"),
    )
    sized = written(
        keyed.join(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "k"), "simhash-keys"
    )
    few = sized.where(F.col("n") <= max_bucket).select("k", "fp")
    start = F.shiftright("k", 32)
    chain = F.lit(False)
    for i in range(m):
        chain = chain | ((start == i) & _chain(F.col("a"), F.col("b"), i))
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), "k")
        .where("a < b")
        .where(chain)
        .select("a", "b")
    )
    many = sized.where(F.col("n") > max_bucket)
    bits = F.sequence(F.lit(0), F.lit(63))
    fixed = F.lit(0).cast("long")
    for i in range(m):
        both = 0
        for s in (i, (i + 1) % m):
            both |= ((1 << SEGMENTS[s]) - 1) << _SHIFTS[s]
        both = both - (1 << 64) if both >> 63 else both
        fixed = F.when(start == i, F.lit(both).cast("long")).otherwise(fixed)
    flips = F.transform(bits, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    free = F.filter(flips, lambda x: x.bitwiseAND(fixed) == 0)
    near = many.select(
        "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), free)).alias("x")
    ).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("v"))
    least = near.groupBy("v").agg(F.min("fp").alias("a"))
    stars = near.join(least, "v").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comps = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    named = written(groups.join(comps, "fp", "left"), "simhash-groups")
    linked = named.where("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = (
        linked.join(least, "component")
        .select("fp", "component_id")
        .unionAll(named.where("component IS NULL").select("fp", F.col("least").alias("component_id")))
    )
    return fps.join(by_fp, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): one row per document."""
    fps = written(fingerprints(docs), "simhash-fps")
    return classes(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, with the columns of ``docs``.

    The row with the smallest doc_id stays, rows without an id last; of several with that id the one with
    the least hash of its text, and of equal texts any one.  Rows are told by their place in the files, so
    that texts which are no duplicates never stand for each other, whatever their ids.  Texts are shuffled
    once, to meet the numbers of the rows that stay.
    """
    rows = located(docs)
    told = rows.select("doc.doc_id", "doc.text", F.xxhash64("doc.text").alias("h"), "file", "row")
    fps = written(fingerprints(told, F.col("h"), F.col("file"), F.col("row")), "simhash-fps")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "file", "row")
    groups = written(fps.groupBy("fp").agg(F.min(order).alias("first")), "simhash-groups")
    comps = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    firsts = groups.join(comps, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("first").alias("first"))
    kept = firsts.select("first.file", "first.row").hint("shuffle_hash")  # two numbers a row
    return rows.join(kept, ["file", "row"], "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
