import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
ENCODER = bpe.Encoder(bpe.Tables(RANKS), public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_as_by_merging(text):
    ids = ENCODER.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500, "ab" * 999, "the" * 700, "<|endoftext|>", "\x85\x1c\xa0 x\n\n  y", "ß日本語😀" * 50])
def test_repeats_and_special_strings(text):
    assert ENCODER.encode(text).tolist() == PLAIN.encode_ordinary(text)


def test_adjacent_tokens_fit_as_merging_says():
    ids = [RANKS[t] for t in (b"a", b"b", b"th", b"e", b"the", b"ing", b" ", b" t", b"he", b"in", b"g")]
    for a in ids:
        for b in ids:
            both = ENCODER.tokens[a] + ENCODER.tokens[b]
            merged = [RANKS[x] for x in bpe.merge_by_rank(both, RANKS)]
            assert ENCODER._fit(a, b) == (merged == [a, b])


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_MEMO", 5)
    e = bpe.Encoder(bpe.Tables(RANKS), public_tokenizers.PATTERN)
    text = " ".join(f"zq{i}xv" for i in range(50))
    assert e.encode(text).tolist() == PLAIN.encode_ordinary(text)
    assert len(e.memo) <= 5 and len(e.older) <= 5 and len(e.fits) <= 5


def test_query(spark):
    texts = [None, "", "Hello wörld", "Hello wörld", "a b\n" * 20000]
    docs = spark.createDataFrame([(i % 4, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(docs).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = PLAIN.encode_ordinary(t or "")
        want.append((i % 4, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    assert bpe.query(docs.limit(0)).count() == 0
