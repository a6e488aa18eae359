import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm

TEXTS = [None, "", "the cat sat on the mat", "The CAT sat", "é日本 the", "zzz unseen words qqq", "the cat sat on the mat", "a" * 3000, "\n \t"]


def brute(rows):
    """(base, score) by the definitions, with dictionaries."""
    train = [b for i, b in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    words = Counter()
    counts = [{} for _ in range(lm.ORDER + 1)]
    for b in train:
        words.update(b.split())
        x = lm.END * lm.ORDER + b + lm.END
        for i in range(lm.ORDER, len(x)):
            for k in range(lm.ORDER + 1):
                counts[k].setdefault(x[i - k : i], Counter())[x[i]] += 1
    n, v = sum(words.values()) + len(train), len(words) + bool(train)

    def step(context, symbol):
        k = 0
        while k < lm.ORDER and context[lm.ORDER - k - 1 :] in counts[k + 1]:
            k += 1
        left, out = 1.0, set()
        while k >= 0:
            m = {s: c for s, c in counts[k].get(context[lm.ORDER - k :], {}).items() if s not in out}
            t, d = sum(m.values()), len(m)
            under = max(t + (0 if len(out | set(m)) == 256 else d), 1)
            if symbol in m:
                return math.log10(left * m[symbol] / under)
            left *= d / under if t else 1
            out |= set(m)
            k -= 1
        return math.log10(left / (256 - len(out)))

    result = []
    for _, b in rows:
        toks = b.split()
        log = lambda c: math.log10((c + 1) / (n + v + 1))
        x = lm.END * lm.ORDER + b + lm.END
        score = sum(step(x[i - lm.ORDER : i], x[i]) for i in range(lm.ORDER, len(x)))
        known = sum(w in words for w in toks) + bool(train)
        result.append((len(toks) + 1, known, n, log(len(train)) + sum(log(words[w]) for w in toks), score))
    return result


@pytest.mark.parametrize("most_words", [lm.MAX_WORDS, 1])
def test_scores_match_brute_force(spark, monkeypatch, most_words):
    monkeypatch.setattr(lm, "MAX_WORDS", most_words)  # 1: nearly all words take the join
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, word string, score double")
    got = {r.doc_id: r for r in lm.query(docs).collect()}
    want = brute([(i, (t or "").encode().lower()) for i, t in rows])
    assert len(got) == len(rows)
    for (i, _), (n, known, total, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert lm.query(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.query(spark.createDataFrame([(held, "ab")], schema)).first()
    assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, 3 * math.log10(1 / 256), rel_tol=1e-6)


def test_held_out_text_of_the_same_kind_scores_above_noise(spark):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3) for i in range(60)] + [(1002, "q#x@z!v^k" * 14)]
    got = lm.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kind = [r.score for r in got if r.held_out and r.doc_id < 60]
    noise = [r.score for r in got if r.doc_id == 1002]
    assert kind and min(kind) > 5 * max(noise) / 2 and min(kind) > max(noise)


@pytest.mark.parametrize("most_grams", [lm.MAX_GRAMS, 8, 0])
def test_rare_contexts_count_in_full(spark, monkeypatch, most_grams):
    monkeypatch.setattr(lm, "MAX_GRAMS", most_grams)  # nearly all grams take the join
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(100 + i, f"the rat {i} zzq\x00ab catalog é" * (i % 3)) for i in range(30)]
    rows += [(200, "a long text of many words " * 4000), (201, "b" * 300_000 + "a long text")]
    got = {r.doc_id: r.score for r in lm.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute([(i, (t or "").encode().lower()) for i, t in rows])
    for (i, _), w in zip(rows, want, strict=True):
        assert math.isclose(got[i], w[-1], rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_of_a_context_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string")
    grams = lm.counted(docs).where("gram IS NOT NULL").select("gram", "n")
    total = grams.agg({"n": "sum"}).first()[0]
    for context in (b"e cat", b"he ca", b"\xff" * 5, b"qqqqq", b"zz at", b"aaaaa"):
        base = int.from_bytes(context, "big") << 8
        asked = spark.createDataFrame([(base + b,) for b in range(256)], "gram long")
        seen = lm._seen(grams).join(asked, "gram", "left_semi").select("gram", "logp")
        novel = lm._never_seen(asked.join(seen, "gram", "left_anti"), grams, total)
        logs = [r.logp for r in seen.unionAll(novel).collect()]
        assert len(logs) == 256 and math.isclose(sum(10**x for x in logs), 1, rel_tol=1e-9)


def test_lookup_finds_all_keys_and_no_others():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000))
    table = lm.Lookup(keys, np.arange(len(keys), dtype=float))
    found, values = table.get(keys)
    assert found.all() and (values == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 48, 20_000), keys)
    assert not table.get(other)[0].any() and not lm.Lookup(keys[:0], values[:0]).get(keys)[0].any()
