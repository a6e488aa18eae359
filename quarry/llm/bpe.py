"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton over all tokens gives the longest token
at each byte of a piece in one scan.  The encoder walks from left to right, takes the longest token and
falls back to shorter ones while the token does not fit the one before it; positions from which nothing
fits are marked and never tried again, which bounds the walk by the piece's length.  Two tokens fit if
merging their bytes by rank would end with exactly these two: that is decided by undoing merges at the
seam, and memoised.  The result is the one that merging by rank gives.

Each match of the split pattern is a piece of its own.  Pieces repeat, so their ids are memoised too, as
packed bytes, in two generations: when the younger is full it becomes the older, whose pieces come back
when they are used.  Memo tables last for a task.  A vocabulary is a bounded parameter: it is read on the
driver and broadcast.

Defined cases: a null or empty text has no tokens and decodes to no bytes; very long texts, and pieces, are
encoded whole; of equal pairs the leftmost is merged first, as by rank; repeated rows are encoded one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_MEMO = 200_000
LONGEST_MEMO = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Plain merging, lowest rank first; with ``below`` only of ranks under it."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = below if below is not None else len(ranks) + 1, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Tables:
    """What a vocabulary determines: tokens by id, the two halves of each, the next shorter prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        self.left = np.arange(size, dtype=np.int32)
        self.right = np.arange(size, dtype=np.int32)
        self.shorter = np.full(size, -1, np.int32)
        self.reachable = np.zeros(size, bool)
        for token, i in ranks.items():
            self.tokens[i] = token
            if len(token) > 1:
                halves = merge_by_rank(token, ranks, i)
                self.reachable[i] = len(halves) == 2
                if len(halves) == 2:
                    self.left[i], self.right[i] = ranks[halves[0]], ranks[halves[1]]
            else:
                self.reachable[i] = True
        for token, i in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:n])
                if j is not None and self.reachable[j]:
                    self.shorter[i] = j
                    break


class Encoder:
    def __init__(self, tables: Tables, pattern: str):
        self.tokens = tables.tokens
        self.left, self.right = tables.left.tolist(), tables.right.tolist()
        self.shorter = tables.shorter.tolist()
        self.size = [len(t) for t in self.tokens]
        self.whole = {t.decode("latin-1"): i for i, t in enumerate(self.tokens) if t}
        self.single = {t.decode("latin-1"): i for i, t in enumerate(self.tokens) if len(t) == 1}
        self.automaton = ahocorasick.Automaton()  # single bytes need no search
        for i, t in enumerate(self.tokens):
            if len(t) > 1 and tables.reachable[i]:
                self.automaton.add_word(t.decode("latin-1"), (i, len(t) - 1))
        self.automaton.make_automaton()
        shift = self.shift = len(self.tokens).bit_length()
        self.joined = {
            a << shift | b: i
            for i, (a, b) in enumerate(zip(self.left, self.right, strict=True))
            if a != i and self.size[i] > 1
        }
        self.pieces = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both by rank ends with ``a`` and ``b``."""
        below, shift = len(self.tokens), self.shift
        while True:
            if self.joined.get(a << shift | b, below) < below:
                return False  # a merge across the seam comes before the last undone one
            a_made, b_made = self.size[a] > 1, self.size[b] > 1
            if not a_made and not b_made:
                return True
            if a_made and (a > b or not b_made):
                below, a = a, self.right[a]
            else:  # equal ranks merge from the left, so that one at the seam comes first
                below, b = b + 1, self.left[b]

    def piece(self, data: str) -> list[int]:
        """Ids of one piece, given as bytes in Latin-1."""
        if (i := self.whole.get(data)) is not None:
            return [i]
        size, fits, shift, n, single = self.size, self.fits, self.shift, len(data), self.single
        longest = [single[c] for c in data]
        for end, (i, back) in self.automaton.iter(data):  # ends ascend: the last one for a start is the longest
            longest[end - back] = i
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if dead[end]:
                good = False
            elif out:
                key = out[-1] << shift | token
                good = fits.get(key)
                if good is None:
                    if len(fits) >= MAX_MEMO:
                        fits.clear()
                    good = fits[key] = self._fit(out[-1], token)
            else:
                good = True
            if good:
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.piece(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= LONGEST_MEMO:
            if len(self.memo) >= MAX_MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as int32."""
        if not text:
            return np.zeros(0, np.int32)
        memo, learn = self.memo, self._learn
        packed = [memo.get(p) or learn(p) for p in self.pieces(text)]
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_ENCODERS: dict[object, Encoder] = {}


def _encoder(tables, pattern: str, key: str) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tables.value, pattern)
    return _ENCODERS[key]


def tokenize(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept columns, ids array<int>, decoded binary): ids of each whole text, and their bytes."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(Tables(read_ranks(path)))
    key = f"{path} {pattern}"

    def run(batches):
        enc = _encoder(tables, pattern, key)
        enc.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                offsets, values, decoded = [0], [], []
                for text in part.column(part.num_columns - 1):
                    ids = enc.encode(text.as_py())
                    values.append(ids)
                    offsets.append(offsets[-1] + len(ids))
                    decoded.append(enc.decode(ids))
                flat = np.concatenate(values) if values else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array(decoded, pa.binary()),
                    ],
                    ["doc_id", *keep, "ids", "decoded"],
                )
        enc.forget()  # an idle worker holds no memo

    kept = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text")).mapInArrow(
        run, f"doc_id long, {kept}ids array<int>, decoded binary"
    )


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    rows = tokenize(docs, path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
