import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import token_files as tf
from quarry.llm.common import new_folder
from quarry.storage import file_system

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def table(ids):
    return tf.Frequencies.fit(*np.unique(ids, return_counts=True))


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (511, 3), (512, 1), (513, 40_000), (70_000, 2), (200_001, 60_000)])
def test_round_trip(n, kinds):
    g = np.random.default_rng(n)
    ids = (g.zipf(1.3, n) % kinds * 7).astype(np.uint32)
    t = table(ids if n else np.array([3], np.uint32))
    assert int(t.freq.sum()) == 1 << t.bits and (t.freq > 0).all()
    words, places, states = tf.encode(ids, t, lanes=64, segment=4096)
    assert len(places) == -(-n // 4096)
    for i, place in enumerate(places):  # each checkpoint on its own
        part = ids[i * 4096 : (i + 1) * 4096]
        assert (tf.decode(words, int(place), states[i], len(part), t) == part).all()
    if n:
        assert (tf.decode(words, 0, states[0], n, t) == ids).all()


def test_size_is_near_the_entropy():
    g = np.random.default_rng(5)
    ids = (g.zipf(1.4, 1 << 18) % 5000).astype(np.uint32)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    words, _, _ = tf.encode(ids, table(ids), tf.LANES, tf.SEGMENT)
    assert 32 * len(words) < 1.02 * len(ids) * -(p * np.log2(p)).sum() + 64 * tf.LANES


def test_tables_survive_bytes_and_damage_is_found():
    t = table(np.array([1, 5, 5, 9], np.uint32))
    data = t.to_bytes()
    again = tf.Frequencies.from_bytes(data)
    assert (again.ids == t.ids).all() and (again.freq == t.freq).all() and again.bits == t.bits
    with pytest.raises(ValueError):
        tf.Frequencies.from_bytes(data[:-9] + bytes([data[-9] ^ 1]) + data[-8:])
    ids = np.array([1, 5, 9, 5] * 50, np.uint32)
    block = bytearray(tf.pack(0, ids, (np.array([1]), np.array([0]), np.array([200])), t))
    assert (tf.Block(bytes(block)).ids(0, t) == ids).all()
    whole = tf.Block(bytes(block))
    whole.states = whole.states ^ np.uint64(1 << 11)
    with pytest.raises(ValueError):
        whole.ids(0, t)
    block[-3] ^= 4
    with pytest.raises(ValueError):
        tf.Block(bytes(block))


TEXTS = [
    "Hello, World! it's  NOT 1234 and\tdon't\r\nwe'll",
    "Größe ÄÖÜ ß é é İstanbul ΣΑΣ ½ ² ª",
    "<|startoftext|> a<|endoftext|>b <| x |>",
    "a\x1cb \x85c  d  e​f ﻿g soft­hyphen",
    "日本語 テキスト 🎉🎉 עברית العربية",
    "́start of a word", "x" * 5000, "'S 'T 'RE !!! ...---...", "\x00 \x7f \x1b[0m", "",
]


def test_words_equal_the_library(library):
    words = tf.Words(open(PATH, encoding="utf-8").read())
    g = np.random.default_rng(7)
    pool = [w for t in TEXTS for w in t.split(" ")] + [chr(c) for c in range(1, 0x250)]
    texts = TEXTS + [" ".join(g.choice(pool, 12)) for _ in range(600)] + ["".join(g.choice(pool, 5)) for _ in range(600)]
    for _ in range(2):  # the second time from the memo
        ends, data = words.encode(pa.array([*texts, None]).slice(1), 2)
        ids = np.frombuffer(data, words.kind)
        size = np.dtype(words.kind).itemsize
        assert len(ends) == len(texts) + 1
        for text, a, b in zip([*texts[1:], ""], ends // size, ends[1:] // size):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids + [2], text


def brute(rows, library):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark, library):
    g = np.random.default_rng(11)
    rows = [(i * 3, " ".join(g.choice(TEXTS, 3))) for i in range(400)] + [(2, None), (5, ""), (None, "no id")]
    rows += [(7, "long text " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    docs = docs.withColumns({c: F.lit(1) for c in ("ids", "start", "width", "h", "t")})
    assert sorted(map(tuple, tf.query(docs).collect()), key=lambda r: r[1]) == brute(rows, library)


def test_repeated_ids(spark):
    rows = [(1, "same")] * 200 + [(1, "other text")] * 100 + [(0, "first")]
    got = sorted(map(tuple, tf.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=lambda r: r[1])
    assert len(got) == 301 and got[0][0] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert len({r[3] for r in got[1:201]} | {r[3] for r in got[201:]}) == 2


def test_empty_table(spark):
    assert tf.query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents_over_blocks(spark, monkeypatch):
    """Files of small blocks: documents of many blocks, blocks without a document's start, documents without ids."""
    monkeypatch.setattr(tf, "BLOCK", 100)
    monkeypatch.setattr(tf, "SEGMENT", 32)
    monkeypatch.setattr(tf, "LANES", 8)
    g = np.random.default_rng(13)
    t = table(np.arange(50, dtype=np.uint32))
    sizes = np.array([0, 5, 0, 1000, 0, 0, 95, 100, 1, 0, 250, 3, 0])
    ids = g.integers(0, 50, sizes.sum()).astype(np.uint32)
    folder = new_folder(spark, "blocks")
    store, at = file_system(folder)
    store.create_dir(at)
    with store.open_output_stream(f"{at}/f") as sink:
        w = tf.Writer(sink, t)
        cuts = np.cumsum([0, *sizes])
        for i in range(0, len(sizes), 2):
            part = sizes[i : i + 2]
            w.add(np.arange(i, i + len(part)), np.zeros(len(part)), part, ids[cuts[i] : cuts[i + len(part)]])
        w.close()
    with store.open_input_file(f"{at}/f") as f:
        for step in (1, 2, 3, 5, 100):
            r, got = tf.Reader(f, t), []
            for a in range(0, len(r.places), step):
                for d, _, s, places, flat in r.documents(a, min(a + step, len(r.places))):
                    ends = np.cumsum(s)
                    got += [(int(x), int(p), flat[e - n : e].tolist()) for x, p, e, n in zip(d, places, ends, s)]
            assert got == [(i, int(cuts[i]), ids[cuts[i] : cuts[i + 1]].tolist()) for i in range(len(sizes))]
