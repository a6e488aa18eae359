import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffix_dedup as sd

RND = random.Random(3)
LONG = "".join(RND.choice("abcd") for _ in range(5000))
TEXTS = [
    None, "", "ab" * 300, "x" * 199, "x" * 200, "y" * 201, LONG[:1000], LONG[300:600], LONG[700:899], LONG[900:] + LONG[:250],
    "é" * 300, LONG, LONG, "unique " + "".join(RND.choice("efgh ") for _ in range(3000)), LONG[2000:2150] + "Q" + LONG[2150:2400],
    LONG[1200:1400], "z" + LONG[1200:1400] + "z",
]


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((d, i))
    cover = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i : i + 200] = b"\1" * 200
    out = []
    for b, c in zip(data, cover, strict=True):
        kept = bytes(x for x, y in zip(b, c, strict=True) if not y)
        runs = sum(y and not (i and c[i - 1]) for i, y in enumerate(c))
        out.append((len(b), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(
    ("most", "group", "hot", "stretch"),
    [(sd.MAX_BLOCKS, sd.MAX_GROUP, sd.HOT, sd.STRETCH), (0, sd.MAX_GROUP, 1, sd.STRETCH), (0, sd.MAX_GROUP, 5, 512), (0, 0, 5, 512), (2, 3, 0, 512)],
)
def test_matches_brute_force(spark, monkeypatch, most, group, hot, stretch):
    monkeypatch.setattr(sd, "MAX_BLOCKS", most)
    monkeypatch.setattr(sd, "MAX_GROUP", group)
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "STRETCH", stretch)
    rows = [(i if i != 5 else None, t, "clash", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, uid int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.query(docs).collect()}
    want = {r[0]: w for r, w in zip(rows, brute(TEXTS), strict=True)}
    assert got == want


def test_empty_table(spark):
    assert sd.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffixes_are_sorted_by_bytes_and_collisions_are_noticed():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (300, 20)).astype(np.uint8)
    length, group = rng.integers(0, 21, 300), rng.integers(0, 5, 300)
    raw = [rows[i, : length[i]].tobytes() for i in range(300)]
    want = sorted(range(300), key=lambda i: (group[i], raw[i], i))

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for spoilt in (False, True):
        s = sd.Suffixes(rows, length, group)
        if spoilt:
            s.hash[:] = 0  # all prefixes collide
        order, shared = s.sorted()
        assert order.tolist() == want
        for k in range(1, 300):
            a, b = order[k - 1], order[k]
            assert shared[k] == (common(raw[a], raw[b]) if group[a] == group[b] else -1)
