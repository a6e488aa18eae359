"""Token ids in compressed files: a static range asymmetric numeral system with shared frequencies.

Documents are dealt by ranges of doc_id, sorted, and tokenised; the ids of all documents are counted, and
the counts become one table of frequencies that sum to a power of two, for all files.  Each part of the
documents is one file of independent blocks.  A block holds ``BLOCK`` ids, dealt to ``LANES`` interleaved
coders whose words are in one stream.  Every ``SEGMENT`` ids it has a checkpoint, which is the place in the
stream with the states of the coders, and a checksum of the segment's ids: decoding may start at any of
them, so blocks and segments are decoded by tasks that know nothing of each other.  A block names the
documents that start in it, and a document may go on through any number of blocks.

Folder: ``frequencies`` (the table), ``index.parquet`` (a row a file: name, first id, ids, documents, blocks)
and ``ids-*.rans``.  Tasks write files under names of their own, and only those in the index count, so that an
attempt that is repeated after a lost executor does no harm.  Only the counts, a row an id of the vocabulary,
and the index, a row a file, reach the driver.

A word between ASCII spaces has the same ids in every text: no rule of the tokenizer looks across white space.
So ids of words are memoised, in two generations of a bounded size, and the library encodes each new word.

Defined cases: a null or empty text has the end id only; very long texts go through as they are; rows that
repeat a doc_id follow each other in the order of their texts, equal rows in any; a null doc_id comes first; an
empty table makes no file, and no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import located, new_folder, written
from quarry.storage import file_system

END_ID = 2
BLOCK = 1 << 20
SEGMENT = 1 << 18
LANES = 2048
#: Blocks that a reading task decodes.
GROUP = 4
#: Documents whose words are looked up at once.
ROWS = 5000
MAX_MEMO = 400_000
LONGEST_MEMO = 48
#: Last of the Latin-1 characters; marks that are a piece of their own after a word of letters.
LATIN, ENDS = "\xff", ".,;:!?)"
MAGIC = b"RANS0001"
#: Coders' states lie in [LOW, LOW << 32); a word of the stream has 32 bits.
LOW = 1 << 31


class Frequencies:
    """Ids of a vocabulary with whole frequencies that sum to ``1 << bits``."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray, bits: int):
        self.ids, self.freq, self.bits = ids.astype(np.uint32), freq.astype(np.uint64), bits
        ends = np.cumsum(self.freq)
        self.low = ends - self.freq
        self.of = np.zeros(int(self.ids.max()) + 1 if len(ids) else 1, np.int32)
        self.of[self.ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), freq.astype(np.int64)) if bits <= 22 else None

    @classmethod
    def fit(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """In proportion to the counts, one at least; what rounding leaves over goes to the most frequent."""
        order = np.argsort(ids)
        ids, counts = np.asarray(ids)[order], [int(c) for c in np.asarray(counts)[order]]
        bits = min(30, max(12, (max(1, len(ids)) - 1).bit_length() + 4))
        total = sum(counts) or 1
        freq = np.array([max(1, (c << bits) // total) for c in counts], np.int64)
        rest = (1 << bits) - int(freq.sum())
        for i in np.argsort(-freq, kind="stable"):
            step = rest if rest > 0 else max(rest, 1 - int(freq[i]))
            freq[i] += step
            rest -= step
            if not rest:
                break
        return cls(ids, freq, bits)

    def to_bytes(self) -> bytes:
        body = struct.pack("<IQ", self.bits, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return MAGIC + body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        body = data[len(MAGIC) : -4]
        if data[: len(MAGIC)] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(body):
            raise ValueError("the table of frequencies is damaged")
        bits, n = struct.unpack_from("<IQ", body)
        ids = np.frombuffer(body, "<u4", n, 12)
        return cls(ids, np.frombuffer(body, "<u4", n, 12 + 4 * n), bits)

    def symbols(self, slots: np.ndarray) -> np.ndarray:
        if self.slots is not None:
            return self.slots[slots]
        return np.searchsorted(self.low, slots, side="right") - 1


def encode(ids: np.ndarray, table: Frequencies, lanes: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, place of each checkpoint in the words, states at each): from the last id to the first."""
    s = table.of[ids]
    freq, low, bits = table.freq[s], table.low[s], np.uint64(table.bits)
    most = freq << np.uint64(63 - table.bits)
    x = np.full(lanes, LOW, np.uint64)
    word = np.uint64(32)
    out, n_out, places, states = [], 0, [], []
    for at in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
        part = slice(at, at + lanes)
        f = freq[part]
        y = x[: len(f)]
        over = y >= most[part]
        if over.any():
            out.append(y[over].astype(np.uint32))
            n_out += len(out[-1])
            y = np.where(over, y >> word, y)
        q = y // f
        x[: len(f)] = (q << bits) + (y - q * f) + low[part]
        if at % segment == 0:
            places.append(n_out)
            states.append(x.copy())
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return words, n_out - np.array(places[::-1], np.int64), np.array(states[::-1], np.uint64).reshape(-1, lanes)


def decode(words: np.ndarray, place: int, state: np.ndarray, n: int, table: Frequencies) -> np.ndarray:
    """The next ``n`` ids from a checkpoint on."""
    x, lanes = state.astype(np.uint64), len(state)
    bits, mask, word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    out = np.empty(n, np.int64)
    for at in range(0, n, lanes):
        y = x[: min(lanes, n - at)]
        slot = y & mask
        s = table.symbols(slot.view(np.int64))
        out[at : at + len(y)] = s
        y = table.freq[s] * (y >> bits) + slot - table.low[s]
        short = np.flatnonzero(y < LOW)
        if len(short):
            y[short] = (y[short] << word) | words[place : place + len(short)]
            place += len(short)
        x[: len(y)] = y
    return table.ids[out]


_HEAD = struct.Struct("<8sQIIIIQI")  # magic, first id, ids, documents, lanes, segment, words, checksum of what follows


def pack(first: int, ids: np.ndarray, docs: tuple[np.ndarray, np.ndarray, np.ndarray], table: Frequencies) -> bytes:
    """A block: head, documents that start in it (id, whether it is null, ids), checksums, checkpoints, words."""
    words, places, states = encode(ids, table, LANES, SEGMENT)
    sums = [zlib.crc32(ids[i : i + SEGMENT].astype("<u4").tobytes()) for i in range(0, len(ids), SEGMENT)]
    body = [a.astype(t).tobytes() for a, t in zip(docs, ("<i8", "u1", "<i8"))]
    body += [np.array(sums, "<u4").tobytes(), places.astype("<i8").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    data = b"".join(body)
    return _HEAD.pack(MAGIC, first, len(ids), len(docs[0]), LANES, SEGMENT, len(words), zlib.crc32(data)) + data


class Block:
    def __init__(self, data: bytes):
        magic, self.first, self.n, n_docs, lanes, self.segment, n_words, told = _HEAD.unpack_from(data)
        if magic != MAGIC or told != zlib.crc32(memoryview(data)[_HEAD.size :]):
            raise ValueError("no block starts here, or it is damaged")
        at, marks = _HEAD.size, -(-self.n // self.segment)

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.docs = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs)
        self.sums, self.places = take("<u4", marks), take("<i8", marks)
        self.states = take("<u8", marks * lanes).reshape(marks, lanes)
        self.words = take("<u4", n_words)

    def ids(self, segment: int, table: Frequencies) -> np.ndarray:
        n = min(self.segment, self.n - segment * self.segment)
        out = decode(self.words, int(self.places[segment]), self.states[segment], n, table)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.sums[segment]:
            raise ValueError(f"checksum of the segment at id {self.first + segment * self.segment} differs")
        return out


class Writer:
    """A file of blocks; takes documents in order and holds a block and the documents that start in it."""

    def __init__(self, sink, table: Frequencies):
        self.sink, self.table = sink, table
        self.held, self.n, self.first, self.at, self.places = [], 0, 0, 0, []
        self.docs = [[], [], [], []]  # id, null, ids, place of the first

    def add(self, doc_ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        starts = self.first + self.n + np.cumsum(sizes) - sizes
        for held, x in zip(self.docs, (doc_ids, null, sizes, starts)):
            held.append(x)
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        docs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in self.docs]
        cut = 0
        while len(ids) - cut >= BLOCK or last and (cut < len(ids) or len(docs[0])):
            here = ids[cut : cut + BLOCK]
            cut += len(here)
            all_of = last and cut == len(ids)
            k = len(docs[0]) if all_of else int(np.searchsorted(docs[3], self.first + len(here)))
            data = pack(self.first, here, tuple(d[:k] for d in docs[:3]), self.table)
            docs = [d[k:] for d in docs]
            self.places.append((self.at, len(data), self.first))
            self.sink.write(data)
            self.at += len(data)
            self.first += len(here)
        self.held, self.docs, self.n = [ids[cut:]], [[d] for d in docs], len(ids) - cut

    def close(self) -> None:
        """The last block, the places of all, and where these begin."""
        self._flush(last=True)
        self.sink.write(np.array(self.places, "<i8").tobytes() + struct.pack("<QQ", self.at, len(self.places)))


class Reader:
    """A file of blocks, read at any of them."""

    def __init__(self, source, table: Frequencies):
        self.source, self.table = source, table
        size = source.size()
        at, n = struct.unpack("<QQ", source.read_at(16, size - 16))
        self.places = np.frombuffer(source.read_at(24 * n, at), "<i8").reshape(n, 3)

    def block(self, i: int) -> Block:
        at, size, _ = (int(x) for x in self.places[i])
        return Block(self.source.read_at(size, at))

    def _segments(self, at: int, i: int):
        """(place of the first id, ids) of the segments from that of id ``at``, in block ``i`` or later, on."""
        for k in range(i, len(self.places)):
            block = self.block(k)
            for segment in range(max(0, at - block.first) // block.segment, len(block.places)):
                yield block.first + segment * block.segment, block.ids(segment, self.table)

    def documents(self, first: int, stop: int):
        """(doc ids, nulls, sizes, places, ids) of the documents that start in each of these blocks."""
        segments, held, low, place = None, [], 0, None
        for i in range(first, stop):
            block = self.block(i)
            ids, null, sizes = block.docs
            if not len(ids):
                continue
            if place is None:  # the ids before belong to a document of an earlier block
                place = self._start(i)
            high = place + int(sizes.sum())
            if segments is None:
                segments = self._segments(place, i)
            have = low + sum(map(len, held))
            while have < high:
                base, got = next(segments)
                if not held:
                    low = base
                held.append(got)
                have = base + len(got)
            flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
            yield ids, null, sizes, place + np.cumsum(sizes) - sizes, flat[place - low : high - low]
            held, low, place = [flat[high - low :]], high, high

    def _start(self, i: int) -> int:
        """Where the first document that starts in block ``i`` has its first id: the one before ends there."""
        for k in range(i - 1, -1, -1):
            before = self.block(k).docs[2]
            if len(before):
                return self._start(k) + int(before.sum())
        return 0


class Words:
    """Ids of texts by the tokenizers library; words between ASCII spaces are memoised, and so are their pieces.

    New words of printable Latin-1 characters are cut into pieces here, and the library's model encodes each new
    piece; if the vocabulary does not work this way (``plain``), and for all other words, the whole library does.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.packed = [np.array(i, self.kind).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.cut = plain(json.loads(vocabulary))
        # printable characters, and what a byte-level vocabulary writes for their bytes
        known = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))]
        self.known = re.compile(f"[{re.escape(''.join(known))}]+").fullmatch
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        shown, more = {}, 256
        for byte in range(256):
            shown[byte] = chr(byte) if byte in printable else chr(more)
            more += byte not in printable
        self.shown = str.maketrans({c: "".join(shown[b] for b in c.encode()) for c in known})

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.shown)
        ids = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(shown)])
        if len(piece) <= LONGEST_MEMO:
            if len(self.pieces) >= MAX_MEMO:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The words that the younger generation does not have."""
        out, new, older, pieces, piece, cut, known = {}, [], self.older, self.pieces, self._piece, self.cut, self.known
        for w in words:
            if (ids := older.get(w)) is None:
                end = w[-1]
                if cut and w.isalpha() and (w.isascii() or max(w) <= LATIN):
                    small = w.lower()
                    ids = pieces.get(small) or piece(small)
                elif cut and end in ENDS and (stem := w[:-1]).isalpha() and (w.isascii() or max(w) <= LATIN):
                    small = stem.lower()
                    ids = (pieces.get(small) or piece(small)) + (pieces.get(end) or piece(end))
                elif cut and known(w) and "<|" not in w:
                    ids = b"".join([pieces.get(p) or piece(p) for p in cut(w.lower())])
                else:
                    new.append(w)
                    continue
            out[w] = ids
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, self.kind).tobytes()
        if len(self.memo) + len(out) > MAX_MEMO:
            self.memo, self.older = {"": b""}, self.memo
        self.memo.update(out if max(map(len, out)) <= LONGEST_MEMO else {w: x for w, x in out.items() if len(w) <= LONGEST_MEMO})
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, pa.Buffer]:
        """Ends of the texts' ids, and the ids, as packed little-endian numbers of ``kind``, each with ``end_id``."""
        for space in "\n\r\t":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " "), " ")
        words = split.flatten().dictionary_encode()
        spelt = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = list(map(self.memo.get, spelt))
        new = {w for w, p in zip(spelt, packed) if p is None}
        if new:
            learnt = self._learn(new)
            packed = [learnt[w] if p is None else p for w, p in zip(spelt, packed)]
        packed.append(b"" if end_id is None else self.packed[end_id])
        at = words.indices.to_numpy().copy()
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        at[ends - 1] = len(packed) - 1  # the empty word after a text's last space
        found = pa.array(packed, pa.binary()).take(pa.array(at))
        offsets = np.frombuffer(found.buffers()[1], "<i4", len(found) + 1)
        return offsets[np.concatenate([[0], ends])], found.buffers()[2]


def plain(vocabulary: dict):
    """The cutting of a word into pieces, if the vocabulary's steps are those that ``Words`` knows; else None."""
    steps, cuts = vocabulary.get("normalizer") or {}, vocabulary.get("pre_tokenizer") or {}
    names = [x["type"] for x in steps.get("normalizers", [])]
    split, *rest = cuts.get("pretokenizers", [{}])
    same = (
        names == ["NFC", "Replace", "Lowercase"]
        and steps["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and split.get("type") == "Split"
        and (split["behavior"], split["invert"]) == ("Removed", True)
        and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        and all(x["content"].startswith("<|") for x in vocabulary.get("added_tokens", []))
        and not vocabulary.get("truncation")
    )
    return regex.compile(split["pattern"]["Regex"]).findall if same else None


_WORDS: dict[int, Words] = {}


def _words(vocabulary: str) -> Words:
    key = hash(vocabulary)
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(vocabulary)
    return _WORDS[key]


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data)])


def tokenised(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, width, ids binary) in ascending order of doc_id, part by part; ``width`` is the bytes of an id."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of a bounded vocabulary

    def run(batches):
        words = _words(vocabulary.value)
        width = np.dtype(words.kind).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ends, ids = words.encode(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(part.num_rows, width, np.int32)), _binary(ends, ids)],
                    ["doc_id", "width", "ids"],
                )

    # equal keys may be many, so the place of a row is the last key of the ranges
    rows = located(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"), F.xxhash64("file", "row").alias("t")
    )
    hashed = rows.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h", "t").sortWithinPartitions("doc_id", "h", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, width int, ids binary")


def counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in _flat(batch)[1]:
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = tokens.select("width", "ids").mapInArrow(run, "id long, n long")
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sizes of the documents of a batch, and their ids in stretches of one width."""
    width = batch.column("width").to_numpy()
    col = batch.column("ids")
    offsets = np.frombuffer(col.buffers()[1], "<i4")[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    sizes = np.diff(offsets) // np.maximum(width, 1)
    cuts = [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), len(width)]
    flat = []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            w, n = int(width[a]), int(offsets[b] - offsets[a])
            flat.append(np.frombuffer(data, f"<u{w}", n // w, int(offsets[a])) if n else np.zeros(0, "<u2"))
    return sizes.astype(np.int64), flat


def _write_part(folder: str, source: str) -> tuple[str, int, int, int]:
    """(name, ids, documents, blocks) of the file that one part of the tokens becomes."""
    store, at = file_system(folder)
    table = _table(folder)
    name, docs, total = f"ids-{uuid.uuid4().hex}.rans", 0, 0
    src, src_at = file_system(source)
    with store.open_output_stream(f"{at}/{name}") as sink, src.open_input_file(src_at) as f:
        out = Writer(sink, table)
        for batch in pq.ParquetFile(f).iter_batches(batch_size=256):
            sizes, flat = _flat(batch)
            ids = np.concatenate([x.astype(np.uint32) for x in flat]) if flat else np.zeros(0, np.uint32)
            d = batch.column("doc_id")
            out.add(d.fill_null(0).to_numpy(), d.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), sizes, ids)
            docs, total = docs + len(sizes), total + len(ids)
        out.close()
    return name, total, docs, len(out.places)


_TABLES: dict[str, Frequencies] = {}


def _table(folder: str) -> Frequencies:
    if folder not in _TABLES:
        _TABLES.clear()
        store, at = file_system(folder)
        with store.open_input_file(f"{at}/frequencies") as f:
            _TABLES[folder] = Frequencies.from_bytes(f.read())
    return _TABLES[folder]


def write(tokens: DataFrame, folder: str) -> None:
    """Token files of a table as ``tokenised`` returns it, with its order."""
    spark = tokens.sparkSession
    held = new_folder(spark, "tokens")
    tokens.write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema(tokens.schema).parquet(held)
    found = counts(tokens).collect()  # a row an id of the vocabulary
    store, at = file_system(folder)
    store.create_dir(at)
    table = Frequencies.fit(np.array([r.id for r in found], np.int64), np.array([r.n for r in found], np.int64))
    with store.open_output_stream(f"{at}/frequencies") as f:
        f.write(table.to_bytes())
    name = F.col("_metadata.file_path")
    parts = tokens.groupBy(name.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    order = F.regexp_extract("source", r"part-(\d+)-", 1).cast("long")

    def run(frames):
        for frame in frames:
            for source, place in zip(frame["source"], frame["place"]):
                yield type(frame)([(place, *_write_part(folder, source))], columns=["place", "name", "ids", "docs", "blocks"])

    rows = parts.select("source", order.alias("place")).repartition(_tasks(spark, parts.count()))
    made = written(rows.mapInPandas(run, "place long, name string, ids long, docs long, blocks long"), "token-files")
    index, first = [], 0
    for r in sorted(made.collect()):  # a row a file
        index.append((r.place, r.name, first, r.ids, r.docs, r.blocks))
        first += r.ids
    columns = list(zip(*index)) or [()] * 6
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
    names = ["place", "name", "first", "ids", "docs", "blocks"]
    with store.open_output_stream(f"{at}/index.parquet") as f:
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), f)
    listed = {r[1] for r in index}
    from pyarrow import fs

    for info in store.get_file_info(fs.FileSelector(at)):
        if info.base_name.endswith(".rans") and info.base_name not in listed:
            store.delete_file(info.path)  # of an attempt that was repeated


def _tasks(spark: SparkSession, n: int) -> int:
    return max(1, min(n, 100_000))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): documents of a folder of token files, ids as little-endian unsigned 32-bit numbers."""
    index = spark.read.parquet(f"{folder}/index.parquet")
    work = index.where("blocks > 0").select(
        "name", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(GROUP).cast("long"))).alias("a"), "blocks"
    )
    work = work.select("name", "first", "a", F.least(F.col("a") + GROUP, F.col("blocks")).alias("b"))

    def run(batches):
        for batch in batches:
            for name, first, a, b in zip(*(batch.column(c).to_pylist() for c in range(4))):
                store, at = file_system(folder)
                with store.open_input_file(f"{at}/{name}") as f:
                    for ids, null, sizes, places, flat in Reader(f, _table(folder)).documents(a, b):
                        ends = np.concatenate([[0], np.cumsum(sizes * 4)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(places + first, pa.int64()), _binary(ends, flat.astype("<u4").tobytes())],
                            ["doc_id", "start", "ids"],
                        )

    return work.repartition(_tasks(spark, work.count())).mapInArrow(run, "doc_id long, start long, ids binary")


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    folder = new_folder(spark, "token-files", keep=True)
    write(tokenised(docs, path or public_tokenizers.path("word_bpe_49k.json")), folder)
    return read(spark, folder).select(
        "doc_id",
        "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
