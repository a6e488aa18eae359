"""Removal of byte strings that occur more than once, by hash-compared suffix sorting.

A byte goes if some string of ``LENGTH`` bytes over it also starts anywhere else.  Whether a string occurs
twice is decided between suffixes: prefix polynomial hashes and binary search give the common extension of
two suffixes in a logarithmic number of steps, a merge sort orders suffixes with it, and neighbours in that
order share the longest extensions.  What these hashes call equal is compared byte by byte afterwards.

Three shortcuts go by long digests alone, without a comparison of bytes: whole texts are equal if their
SHA-256 is, equal blocks (below) and the strings of overfull groups by 128 bits of XXH3.

Suffixes that cannot have a twin never meet.  Of the grams of ``GRAM`` bytes in a string the one with the
least hash is its anchor: equal strings have equal anchors at equal places, and only about one position in
70 is an anchor.

1. Anchors whose gram occurs once are dropped (a count by hash, combined map-side).
2. The block of an anchor is the span of all strings that it anchors.  Equal blocks, whole copies above
   all, are settled by a 128-bit hash, and one of them stands for the others from then on.
3. The different blocks of a gram are sorted by the suffixes that start at the anchor, and by what precedes
   it, read backwards.  A string that starts o bytes before the anchor has a twin if another block shares
   o bytes to the left and LENGTH - o to the right: both are runs of the sorted orders, found for all
   blocks of a task at once, without looking at pairs.

Grams with more than ``MAX_BLOCKS`` different blocks are dealt by the bytes around the anchor as well, in
three classes of o, each by the bytes that all its strings contain; strings that are equal still meet.  Where
even such a group has more than ``MAX_GROUP`` blocks, its strings are counted one by one by their digests, so
that no task has to hold a group beyond these bounds.  Blocks that make up a thousandth of all or more are at
most a thousand, and are sent to all tasks, so that the rows of a hot one stay where they are; so are texts
that are as often equal.

Whole texts that are equal are looked at once.  The texts are written to the shared folder once, each
partition with a number, and what is found is written by that number, so that a later pass over a
partition reads just its part and no text is ever shuffled.

Defined cases: a null text is empty; a very long text is looked at in stretches; texts of fewer than ``LENGTH`` bytes stay whole; repeated rows are
copies of each other; null or repeated doc_ids are carried along; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import new_folder, written

LENGTH = 200
GRAM = 64
MAX_BLOCKS = 1_000
MAX_GROUP = 1_000
#: Blocks at least this often, as a share of all, are hot.
HOT = 1_000
#: Windows are looked at in stretches of so many starts; a longer text is several stretches.
STRETCH = 1 << 20
#: Least distances of a string's start from its anchor, per class of a gram with too many blocks.
CLASSES = (0, 40, 90)
_B = 0x9E3779B97F4A7C15
_U = np.uint64
_PID = 33  # monotonically_increasing_id: the partition is above this bit
_BYTES = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64, endpoint=False)


# --- hashes and suffix order -------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Polynomial hash of each gram of ``size`` bytes (a power of two), doubled up from single bytes."""
    h, n, base = _BYTES[data], 1, _B
    while n < size:
        h = h[:-n] * _U(base) + h[n:]
        base, n = base * base & (1 << 64) - 1, 2 * n
    h = (h ^ h >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    return h ^ h >> _U(29)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first start, last start): each run of starts of strings with the same anchor."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    b = np.frombuffer(data, np.uint8)
    wide = LENGTH - GRAM + 1
    for at in range(0, len(b) - LENGTH + 1, STRETCH):
        part = b[at : at + STRETCH + LENGTH - 1]
        h = gram_hashes(part)
        low = _U((1 << 24) - 1)
        key = h & ~low | np.arange(len(h), dtype=np.uint64)  # least hash, then leftmost
        pad = -len(key) % wide
        x = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, wide)
        ahead = np.minimum.accumulate(x, axis=1).ravel()
        behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - wide + 1
        who = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        last = np.append(first[1:], n) - 1
        for o, v in zip(out, (h[who[first]].view(np.int64), who[first] + at, first + at, last + at), strict=True):
            o.append(v)
    if not out[0]:
        return tuple(np.zeros(0, np.int64) for _ in out)
    return tuple(np.concatenate(o) for o in out)


class Suffixes:
    """Rows of bytes of given lengths, in groups, that can be sorted by common extensions."""

    def __init__(self, rows: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.rows, self.length, self.group = rows, length, group
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(max(rows.shape[1] - 1, 0), _U(_B))]))
        self.hash = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum(_BYTES[rows] * powers[None, : rows.shape[1]], axis=1, out=self.hash[:, 1:])
        self.steps = int(rows.shape[1]).bit_length()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows i and j, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.length[i], self.length[j])
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = self.hash[i, mid] == self.hash[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return np.minimum(low, high)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether row i sorts before row j: by group, bytes, length, and row number last."""
        n = self.extension(i, j)
        last = self.rows.shape[1] - 1
        a = np.where(n < self.length[i], self.rows[i, np.minimum(n, last)].astype(np.int64), -1)
        b = np.where(n < self.length[j], self.rows[j, np.minimum(n, last)].astype(np.int64), -1)
        less = np.where(a != b, a < b, i < j)
        return np.where(self.group[i] != self.group[j], self.group[i] < self.group[j], less)

    def order(self) -> np.ndarray:
        """Merge sort, all merges of a width at once; an element's place is found by binary search."""
        n = len(self.rows)
        order = np.argsort(self.group, kind="stable")
        width = 1
        while width < n:
            cut = np.arange(width, n, 2 * width)
            mixed = cut[~self.before(order[cut - 1], order[cut])]  # others are in order already
            at = (mixed[:, None] - width + np.arange(2 * width)).ravel()
            at = at[at < n]
            if len(at):
                base = at // width * width
                other = (at // width ^ 1) * width
                low, high = other.copy(), np.minimum(other + width, n)
                x = order[at]
                while len(live := np.flatnonzero(low < high)):
                    mid = (low[live] + high[live]) >> 1
                    less = self.before(order[mid], x[live])
                    low[live] = np.where(less, mid + 1, low[live])
                    high[live] = np.where(less, high[live], mid)
                order[np.minimum(base, other) + (at - base) + (low - other)] = x
            width *= 2
        return order

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the row before; -1 where a group starts), verified."""
        order = self.order()
        shared = np.full(len(order), -1, np.int64)
        i, j = order[:-1], order[1:]
        same = np.flatnonzero(self.group[i] == self.group[j])
        shared[same + 1] = self.extension(i[same], j[same])
        if not self._verified(order, shared):  # a collision: bytes decide
            raw = [self.rows[r, : self.length[r]].tobytes() for r in range(len(order))]
            order = np.array(sorted(range(len(raw)), key=lambda r: (self.group[r], raw[r], r)), np.int64)
            shared[:] = -1
            for k in range(1, len(order)):
                if self.group[order[k]] == self.group[order[k - 1]]:
                    a, b = raw[order[k - 1]], raw[order[k]]
                    d = np.flatnonzero(np.frombuffer(a[: len(b)], np.uint8) != np.frombuffer(b[: len(a)], np.uint8))
                    shared[k] = d[0] if len(d) else min(len(a), len(b))
        return order, shared

    def _verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        column = np.arange(self.rows.shape[1])[None, :]
        for at in range(1, len(order), 4096):
            k = np.arange(at, min(at + 4096, len(order)))
            same = self.rows[order[k - 1]] == self.rows[order[k]]
            if not (same | (column >= shared[k][:, None])).all():
                return False
        return True


def twins(group: np.ndarray, left: np.ndarray, blocks: list[bytes], least: np.ndarray, most: np.ndarray):
    """Whether each string of each block has a twin in another block of its group.

    ``left``: bytes of the block before its anchor.  Strings are numbered by o, the distance of their start
    before the anchor; those with least <= o <= most are asked for.  Rows of the result are blocks,
    columns o.
    """
    n = len(blocks)
    size = np.fromiter(map(len, blocks), np.int64, n)
    right = size - left
    rows = np.zeros((n, LENGTH), np.uint8)
    back = np.zeros((n, LENGTH - GRAM), np.uint8)
    for i, b in enumerate(blocks):
        x = np.frombuffer(b, np.uint8)
        rows[i, : right[i]] = x[left[i] :]
        back[i, : left[i]] = x[: left[i]][::-1]
    ahead, to_right = Suffixes(rows, right, group).sorted()
    behind, to_left = Suffixes(back, left, group).sorted()
    found = np.zeros((n, LENGTH - GRAM + 1), bool)
    kind_r, kind_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(least.min()), int(most.max()) + 1):
        kind_r[ahead] = np.cumsum(to_right < LENGTH - o)
        kind_l[behind] = np.cumsum(to_left < o)
        ask = np.flatnonzero((least <= o) & (o <= most))
        _, where, count = np.unique(kind_r[ask] * (n + 1) + kind_l[ask], return_inverse=True, return_counts=True)
        found[ask, o] = count[where] > 1
    return found


# --- passes over the texts ---------------------------------------------------------------------------


def _storage(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(url.path)
    return fs.FileSystem.from_uri(path)


class Found:
    """What an earlier step wrote about the texts of one partition: rows by uid."""

    def __init__(self, folder: str, columns: tuple[str, ...]):
        self.folder, self.columns, self.pid, self.rows = folder, columns, None, {}

    def of(self, uid: int) -> tuple[np.ndarray, ...] | None:
        if self.pid != uid >> _PID:
            self.pid, self.rows = uid >> _PID, self._load(uid >> _PID)
        return self.rows.get(uid)

    def _load(self, pid: int) -> dict:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, inner = _storage(self.folder)
        infos = store.get_file_info(fs.FileSelector(f"{inner}/pid={pid}", allow_not_found=True))
        tables = []
        for info in infos:
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as f:
                    tables.append(pq.ParquetFile(f).read(columns=["uid", *self.columns]))
        if not tables:
            return {}
        t = pa.concat_tables(tables)
        uid = t.column("uid").to_numpy()
        order = np.argsort(uid, kind="stable")
        uid = uid[order]
        values = [t.column(c).to_numpy()[order] for c in self.columns]
        cut = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])) if len(uid) else []
        stop = np.append(cut[1:], len(uid)) if len(uid) else []
        return {int(uid[a]): tuple(v[a:b] for v in values) for a, b in zip(cut, stop, strict=True)}


def _stored(rows: DataFrame, name: str) -> str:
    """Writes rows with a uid by the partition that holds the text."""
    folder = new_folder(rows.sparkSession, name)
    rows = rows.withColumn("pid", F.shiftright("uid", _PID))
    rows.repartition("pid").write.partitionBy("pid").parquet(folder)
    return folder


def _rows(parts: list[tuple[np.ndarray, ...]], uids: list[int], names: list[str]):
    sizes = [len(p[0]) for p in parts]
    columns = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(len(parts[0]))]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(uids, np.int64), sizes)), *columns], ["uid", *names])


def _anchor_pass(copies: str):
    def run(batches):
        skip = Found(copies, ("rep",))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                parts, uids = [], []
                for uid, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    data = text.as_py()
                    if len(data) < LENGTH or (x := skip.of(uid)) and x[0][0] != uid:
                        continue
                    h, p, a, b = anchors(data)
                    parts.append((h, p, a, b))
                    uids.append(uid)
                if parts:
                    yield _rows(parts, uids, ["h", "p", "a", "b"])

    return run


def _block_pass(dup: str):
    def run(batches):
        known = Found(dup, ("h", "p", "a", "b"))
        for batch in batches:
            parts, uids = [], []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (x := known.of(uid)) is None:
                    continue
                data, (h, p, a, b) = text.as_py(), x
                digest = xxhash.xxh3_128_digest
                keys = b"".join([digest(data[s : e + LENGTH]) for s, e in zip(a.tolist(), b.tolist(), strict=True)])
                two = np.frombuffer(keys, np.int64).reshape(-1, 2)
                parts.append((h, two[:, 0], two[:, 1], p, a, b))
                uids.append(uid)
            if parts:
                yield _rows(parts, uids, ["h", "b1", "b2", "p", "a", "b"])

    return run


def _share(p: int, a: int, b: int, c: int) -> tuple[int, int]:
    """Least and most distance before its anchor of the strings of a block in a class; all without one (-1)."""
    low, high = (0, LENGTH) if c < 0 else (CLASSES[c], (CLASSES + (LENGTH,))[c + 1] - 1)
    return max(p - b, low), min(p - a, high)


def _class_pass(many: str):
    """(h, sub, c, uid, p, a, b): the classes of each block, ``sub`` from the bytes that its strings share."""
    names = ["h", "sub", "c", "p", "a", "b"]

    def run(batches):
        known = Found(many, ("h", "p", "a", "b"))
        for batch in batches:
            parts, uids = [], []
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (x := known.of(uid)) is None:
                    continue
                data, out = text.as_py(), []
                for h, p, a, b in zip(*(v.tolist() for v in x), strict=True):
                    for c, low in enumerate(CLASSES):
                        least, most = _share(p, a, b, c)
                        if least <= most:
                            high = (CLASSES + (LENGTH,))[c + 1] - 1
                            out.append((h, xxhash.xxh3_64_intdigest(data[p - low : p + LENGTH - high], c + 1) >> 1, c, p, a, b))
                if out:
                    parts.append(tuple(np.array(v, np.int64) for v in zip(*out, strict=True)))
                    uids.append(uid)
            if parts:
                yield _rows(parts, uids, names)

    return run


def _string_pass(overfull: str):
    """(uid, s, k1, k2): each string of the classes of overfull groups."""

    def run(batches):
        known = Found(overfull, ("c", "p", "a", "b"))
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (x := known.of(uid)) is None:
                    continue
                data = text.as_py()
                starts = []
                for c, p, a, b in zip(*(v.tolist() for v in x), strict=True):
                    least, most = _share(p, a, b, c)
                    starts.append(np.arange(p - most, p - least + 1))
                starts = np.unique(np.concatenate(starts))
                for at in range(0, len(starts), 1 << 16):
                    s = starts[at : at + (1 << 16)]
                    keys = b"".join([xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in s.tolist()])
                    two = np.frombuffer(keys, np.int64).reshape(-1, 2)
                    yield _rows([(s, two[:, 0], two[:, 1])], [uid], ["s", "k1", "k2"])

    return run


def _content_pass(wanted: str):
    names = ["h", "sub", "uid", "p", "a", "least", "most", "block"]

    def run(batches):
        known = Found(wanted, ("h", "sub", "c", "p", "a", "b"))
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (x := known.of(uid)) is None:
                    continue
                data = text.as_py()
                for h, sub, c, p, a, b in zip(*(v.tolist() for v in x), strict=True):
                    block = data[a : b + LENGTH]
                    held += len(block)
                    for o, v in zip(out, (h, sub, uid, p, a, *_share(p, a, b, c), block), strict=True):
                        o.append(v)
                if held > 8 << 20:
                    yield _content(out, names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield _content(out, names)

    return run


def _content(out: list[list], names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(v, pa.int64()) for v in out[:-1]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(out[-1], pa.binary())], names)


def _twin_pass(batches):
    """Rows sorted by (h, sub): whole groups are compared, many at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 8000:
            t = pa.Table.from_batches(held).combine_chunks()
            h, sub = t.column("h").to_numpy(), t.column("sub").to_numpy()
            change = np.flatnonzero((h[1:] != h[:-1]) | (sub[1:] != sub[:-1]))
            if len(change):
                cut = int(change[-1]) + 1
                yield from _twin_rows(t.slice(0, cut))
                t = t.slice(cut)
            held, size = t.to_batches(), t.num_rows
    if held:
        yield from _twin_rows(pa.Table.from_batches(held))


def _twin_rows(t: pa.Table):
    h, sub, uid, p, a, least, most = (t.column(c).to_numpy() for c in ("h", "sub", "uid", "p", "a", "least", "most"))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])])
    group = np.cumsum(new)
    alone = np.bincount(group)[group] < 2
    keep = np.flatnonzero(~alone)
    if not len(keep):
        return
    blocks = t.column("block").take(pa.array(keep)).to_pylist()
    found = twins(group[keep], (p - a)[keep], blocks, least[keep], most[keep])
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    if len(row):  # o from low to high - 1: starts p - high + 1 to p - low
        at = p[keep][row]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid[keep][row]), pa.array(at - high + 1), pa.array(at - low + LENGTH)], ["uid", "s", "e"]
        )


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], s[1:] > e[:-1]])
    return s[first], e[np.append(np.flatnonzero(first)[1:] - 1, len(e) - 1)]


def _result_pass(copies: str, removed: str):
    def run(batches):
        same, known = Found(copies, ("rep",)), Found(removed, ("s", "e"))
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for uid, doc, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True
            ):
                data = text.as_py()
                if len(data) >= LENGTH and same.of(uid):
                    s, e = [0], [len(data)]
                elif x := known.of(uid):
                    s, e = (v.tolist() for v in spans(*x))
                else:
                    s, e = [], []
                kept = b"".join(data[a:b] for a, b in zip([0, *e], [*s, len(data)], strict=True))
                row = (doc, len(data), [list(z) for z in zip(s, e, strict=True)], kept, hashlib.sha256(kept).hexdigest())
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds, strict=True)],
                ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"],
            )

    return run


def _several(rows: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Written rows whose key occurs more than once, with the other columns of ``counts`` (keys, n, ...), if it is given."""
    if counts is None:
        counts = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "suffix-counts")
    counts = counts.where("n > 1")
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("n") * HOT >= F.lit(total)).drop("n"))  # at most HOT rows, as they add up to all
    rest = counts.where(F.col("n") * HOT < F.lit(total)).drop("n")
    return rows.join(hot, keys).unionAll(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans removed as [start, end), kept bytes, their SHA-256): one row per document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    spark = docs.sparkSession
    path = new_folder(spark, "suffix-texts")
    (
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            raw.alias("data"),
            F.unhex(F.sha2(raw, 256)).alias("sha"),
        )
        .write.option("compression", "zstd")
        .parquet(path)
    )
    texts = spark.read.schema("uid long, doc_id long, data binary, sha binary").parquet(path)

    marks = texts.select("uid", "sha")
    same = written(marks.groupBy("sha").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-same")
    copies = _stored(_several(marks, ["sha"], same).select("uid", "rep"), "suffix-copies")

    found = texts.select("uid", "data").mapInArrow(_anchor_pass(copies), "uid long, h long, p long, a long, b long")
    packed = found.select(
        "h", "uid", (F.col("p") * 65536 + (F.col("p") - F.col("a")) * 256 + (F.col("p") - F.col("b"))).alias("x")
    )
    # a table of its own: adaptive execution can then split the join's hot keys
    often = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "suffix-often")
    p = F.shiftright("x", 16)
    dup = packed.join(often, "h").select(
        "uid",
        "h",
        p.alias("p"),
        (p - F.shiftright("x", 8).bitwiseAND(F.lit(255).cast("long"))).alias("a"),
        (p - F.col("x").bitwiseAND(F.lit(255).cast("long"))).alias("b"),
    )
    dup_folder = _stored(dup, "suffix-anchors")

    blocks = written(
        texts.select("uid", "data").mapInArrow(
            _block_pass(dup_folder), "uid long, h long, b1 long, b2 long, p long, a long, b long"
        ),
        "suffix-blocks",
    )
    kinds = written(
        blocks.groupBy("h", "b1", "b2").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "p", "a", "b")).alias("rep")
        ),
        "suffix-kinds",
    )
    several = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "suffix-several")
    rivals = kinds.join(several, "h").select("rep.uid", "h", "rep.p", "rep.a", "rep.b", "m")
    zero = F.lit(0).cast("long")
    wanted = rivals.where(F.col("m") <= MAX_BLOCKS).select("uid", "h", zero.alias("sub"), (zero - 1).alias("c"), "p", "a", "b")
    many = rivals.where(F.col("m") > MAX_BLOCKS).drop("m")
    pieces = []
    if not several.where(F.col("m") > MAX_BLOCKS).isEmpty():
        classes = written(
            texts.select("uid", "data").mapInArrow(
                _class_pass(_stored(many, "suffix-many")), "uid long, h long, sub long, c long, p long, a long, b long"
            ),
            "suffix-classes",
        )
        sizes = written(classes.groupBy("h", "sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-groups")
        wanted = wanted.unionByName(classes.join(sizes.where(F.col("n") <= MAX_GROUP).drop("n"), ["h", "sub"]).select(*wanted.columns))
        overfull = sizes.where(F.col("n") > MAX_GROUP).select("h", "sub")
        if not overfull.isEmpty():
            folder = _stored(classes.join(overfull, ["h", "sub"]).select("uid", "c", "p", "a", "b"), "suffix-overfull")
            strings = written(
                texts.select("uid", "data").mapInArrow(_string_pass(folder), "uid long, s long, k1 long, k2 long"), "suffix-strings"
            )
            pieces.append(_several(strings, ["k1", "k2"]).select("uid", "s", (F.col("s") + LENGTH).alias("e")))
    content = texts.select("uid", "data").mapInArrow(
        _content_pass(_stored(wanted, "suffix-wanted")),
        "h long, sub long, uid long, p long, a long, least long, most long, block binary",
    )
    partial = (
        content.repartition("h", "sub")  # at most MAX_BLOCKS or MAX_GROUP rows a key
        .sortWithinPartitions("h", "sub")
        .mapInArrow(_twin_pass, "uid long, s long, e long")
    )
    whole = _several(blocks, ["h", "b1", "b2"], kinds.drop("rep")).select("uid", F.col("a").alias("s"), (F.col("b") + LENGTH).alias("e"))
    for piece in (whole, *pieces):
        partial = partial.unionAll(piece)
    removed = _stored(partial, "suffix-removed")
    return texts.select("uid", "doc_id", "data").mapInArrow(
        _result_pass(copies, removed),
        "doc_id long, n_bytes long, spans array<array<long>>, kept binary, kept_sha256 string",
    )


def query(docs: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return deduplicated(docs).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
