"""Vector codes: product quantisation in whole numbers, whose nearest entries are found by VA-file filtering.

Components become floor(256 * x), and vectors are cut into ``PARTS`` equal parts, each with a codebook of at
most ``ENTRIES`` entries.  To find a part's nearest entry, the entries of its codebook are a vector-approximation
file: each coordinate's range is cut into ``1 << BITS`` cells at quantiles of the entries, and an entry is kept as
the cells of its coordinates.  Per part of a vector and coordinate, a lookup table has the least and the greatest
squared difference to each cell; their sums over an entry's cells bound its distance from below and above.  Only
entries whose lower bound is not above the least upper bound are compared in whole numbers.

Each round is one pass in which a task returns sums and counts by part and entry, ``PARTS`` * ``ENTRIES`` rows at
most, which are added up before the driver takes the new codebooks.  So neither the number of vectors nor that of
their labels goes to the driver, and a codebook is the only thing that all tasks get.

Whole numbers are exact: where squares of a batch may leave 64 bits it is worked out in Python's numbers.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped, and so are empty
vectors and those of another length than the first one by (vec_id, vector); vectors are padded with zeros to a
multiple of ``PARTS``; components beyond the range of 32-bit floats count as infinite; of rows that repeat a vec_id each counts; null vec_ids come after all others; with less than
``ENTRIES`` vectors the codebooks are smaller; an error beyond a long is null, and label_error then leaves it
out; an empty table has no rows; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Bits of a coordinate's cell.
BITS = 3
#: Parts whose bounds are worked out at once.
TILE = 8192
#: Components up to this size have sums of squares, and of components, within 64 bits.
SAFE = 1 << 25
#: Base of the digits in which sums of any size leave a task.
BASE = 10**18
#: Sums by label are sent to every task up to this number of labels.
MAX_BROADCAST = 100_000


def usable(v: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("float")) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & (F.size(v) > 0), F.lit(False))


def whole(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 * x) of flattened vectors, padded, as (n, PARTS, width)."""
    x = np.floor(flat.astype(np.float64) * SCALE).reshape(-1, dim)
    if x.size and np.abs(x).max() >= SAFE:
        x = np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)
    else:
        x = x.astype(np.int64)
    width = -(-dim // PARTS)
    if width * PARTS > dim:
        x = np.concatenate([x, np.zeros((len(x), width * PARTS - dim), x.dtype)], axis=1)
    return x.reshape(len(x), PARTS, width)


class Cells:
    """A codebook (entries, width) as a vector-approximation file."""

    def __init__(self, book: np.ndarray):
        self.book = book
        n, width = book.shape
        cells = 1 << BITS
        self.low, self.high = np.zeros((width, cells), book.dtype), np.zeros((width, cells), book.dtype)
        self.cell = np.zeros((n, width), np.int64)
        for d in range(width):
            values = np.sort(book[:, d])
            edges = np.unique(values[(np.arange(1, cells) * n) // cells])  # cells begin at quantiles of the entries
            self.cell[:, d] = np.searchsorted(edges, book[:, d], side="right")
            for c in range(cells):
                here = book[self.cell[:, d] == c, d]  # a cell spans its entries, an empty one nothing
                if len(here):
                    self.low[d, c], self.high[d, c] = here.min(), here.max()

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of (n, width) parts to each entry."""
        lower = upper = 0
        for d in range(x.shape[1]):
            q = x[:, d, None]
            below, above = self.low[d] - q, q - self.high[d]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower = lower + (near * near)[:, self.cell[:, d]]
            upper = upper + (far * far)[:, self.cell[:, d]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each part, lowest index first, its squared distance, and how many entries were compared."""
        index, error, compared = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
        for a in range(0, len(x), TILE):
            part = x[a : a + TILE]
            lower, upper = self.bounds(part)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])  # by row, and by entry within it
            gap = part[row] - self.book[entry]
            distance = (gap * gap).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(part)))
            least = np.minimum.reduceat(distance, starts)
            at = np.flatnonzero(distance == least[row])
            first = at[np.searchsorted(row[at], np.arange(len(part)))]
            index[a : a + TILE], error[a : a + TILE] = entry[first], least
            compared += len(row)
        return index, error, compared


def _batches(batches, dim: int):
    """Each batch with its vectors as whole numbers."""
    for batch in batches:
        if batch.num_rows:
            yield batch, whole(np.asarray(batch.column("v").flatten()), dim)


def _books(first: np.ndarray) -> list[np.ndarray]:
    return [first[:, p, :] for p in range(PARTS)]


def _cells(books: list[np.ndarray], x: np.ndarray) -> list[Cells]:
    return [Cells(b.astype(object) if x.dtype == object else b) for b in books]


def _safe(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return x.astype(object) if x.dtype != object and any(b.dtype == object for b in books) else x


def assigned_sums(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(part, entry, d, s0, s1, s2, n): what each task has assigned to an entry, sums in digits of base ``BASE``."""

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for _, x in _batches(batches, dim):
            x = _safe(x, books)
            for p, cells in enumerate(_cells(books, x)):
                index, _, _ = cells.nearest(x[:, p, :])
                for e in np.unique(index).tolist():
                    mine = x[index == e, p, :]
                    held = sums.setdefault((p, e), [[0] * mine.shape[1], 0])
                    held[0] = [a + int(b) for a, b in zip(held[0], mine.sum(axis=0))]
                    held[1] += len(mine)
        rows = [(p, e, d, s % BASE, s // BASE % BASE, s // BASE**2, n) for (p, e), (v, n) in sums.items() for d, s in enumerate(v)]
        columns = list(zip(*rows)) or [()] * len(_SUMS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _SUMS)

    return vectors.select("v").mapInArrow(run, ", ".join(f"{c} long" for c in _SUMS))


_SUMS = ["part", "entry", "d", "s0", "s1", "s2", "n"]


def moved(books: list[np.ndarray], found) -> list[np.ndarray]:
    """Codebooks whose entries are the floored means of their parts; unused entries stay."""
    out = [b.astype(object) for b in books]
    for r in found:
        out[r.part][r.entry, r.d] = (int(r.s0) + int(r.s1) * BASE + int(r.s2) * BASE**2) // r.n
    return [narrow(b) for b in out]


def narrow(b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) if not b.size or max(abs(int(c)) for c in b.ravel()) < SAFE else b


def trained(vectors: DataFrame, dim: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds; they start as the parts of the first vectors."""
    first = vectors.select("v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()  # ENTRIES rows
    books = [narrow(b) for b in _books(whole(np.array([c for r in first for c in r.v]), dim))]
    for _ in range(rounds):
        sums = assigned_sums(vectors, books, dim)
        digits = [F.sum(F.col(s).cast("decimal(20,0)")).alias(s) for s in ("s0", "s1", "s2")]
        added = sums.groupBy("part", "entry", "d").agg(*digits, F.sum("n").alias("n"))
        books = moved(books, added.collect())  # a row a part, entry and component
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, label, code, error): the final assignment."""
    hexes = np.array([f"{i:02x}" for i in range(max(ENTRIES, 256))])

    def run(batches):
        for batch, x in _batches(batches, dim):
            x = _safe(x, books)
            index, error = np.zeros((len(x), PARTS), np.int64), [0] * len(x)
            for p, cells in enumerate(_cells(books, x)):
                index[:, p], e, _ = cells.nearest(x[:, p, :])
                error = error + e if p else e
            codes = ["".join(row) for row in hexes[index].tolist()]
            error = [int(e) if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    label = dict(vectors.dtypes)["label"]
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def kept(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of usable vectors of one length, and that length."""
    v = F.col("embedding")
    rows = vectors.where(usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    dim = first.n if first else PARTS
    return rows.where(F.size("v") == dim), dim


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(c)) for b in books for c in b.ravel())


def query(vectors: DataFrame) -> DataFrame:
    rows, dim = kept(vectors)
    books = trained(rows, dim)
    coded = written(encoded(rows, books, dim), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = written(coded.groupBy("label").agg(total.alias("label_error")), "label-errors")
    if by_label.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        by_label = F.broadcast(by_label)
    same = coded["label"].eqNullSafe(by_label["label"])
    return coded.join(by_label, same).select(
        coded["vec_id"],
        coded["code"],
        coded["error"],
        F.expr("try_cast(label_error AS bigint)").alias("label_error"),
        F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"),
    )


_D = "list_sum(list_transform(list_zip(q.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEAREST = f"SELECT q.uid, q.p, q.e, arg_min(b.i, {{{{'d': {_D}, 'i': b.i}}}}) AS i, min({_D}) AS d FROM q JOIN {{book}} b ON b.p = q.p GROUP BY q.uid, q.p, q.e"


def _moved(book: str, at: str) -> str:
    return f"""SELECT b.p, b.i, coalesce(m.e, b.e) AS e FROM {book} b LEFT JOIN (
    SELECT p, i, list(f ORDER BY d) AS e FROM (SELECT p, i, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
      FROM (SELECT p, i, unnest(e) AS x, unnest(range(len(e))) AS d FROM {at}) GROUP BY p, i, d) GROUP BY p, i) m ON m.p = b.p AND m.i = b.i"""


#: All distances, for small tables of vectors whose length is a multiple of PARTS.
ORACLE_SQL = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS uid, CAST(vec_id AS BIGINT) AS vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT uid, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS e FROM v, range({PARTS}) t(p)),
b0 AS (SELECT p, uid AS i, e FROM q WHERE uid < {ENTRIES}),
a1 AS ({_NEAREST.format(book="b0")}), b1 AS ({_moved("b0", "a1")}),
a2 AS ({_NEAREST.format(book="b1")}), b2 AS ({_moved("b1", "a2")}),
a3 AS ({_NEAREST.format(book="b2")}),
c AS (SELECT uid, string_agg(lower(lpad(to_hex(i), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY uid),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, i, d)) AS books FROM (SELECT p, i, unnest(e) AS x, unnest(range(len(e))) AS d FROM b2))
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.books AS codebooks_sha256
FROM v JOIN c ON c.uid = v.uid, h
"""
