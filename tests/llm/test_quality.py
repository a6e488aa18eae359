import re
from collections import Counter

from quarry.llm import quality

TEXTS = [
    None, "", " \t\n ", "one two three", "a b c d e f g h i j", "the cat sat on the mat and the dog ran off home again",
    "Shti " * 300, "ABC!! DEF!! " * 20, "x### y$$$ z%%% " * 10, "same line here\n" * 40, "na me  wide é\u000bß " * 9,
    "a | b | c | d | e | f | g | h | i | j | k", "w " * 9, " ".join(f"w{i}" for i in range(20000)),
]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n


def test_measurements_match_brute_force(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(0, TEXTS[5], "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = quality.query(docs).collect()
    assert len(got) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id, *(r[x] for x in names)) for r in got) == sorted((r[0], *brute(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = quality.ledger(docs)
    base = {r.doc_id for r in quality.apply_policy(ledger, "base-1").where("kept").collect()}
    web = {r.doc_id for r in quality.apply_policy(ledger, "web-1").where("kept").collect()}
    assert web < base and 5 in web and 13 in web and not web & {0, 1, 6, 7, 8, 9, 11}
    bits = {r.doc_id: r.fail_bits for r in ledger.collect()}
    for r in quality.ablation(ledger).collect():
        bit = quality.mask([r.rule])
        assert r.failed == sum(1 for b in bits.values() if b & bit)
        assert r.only_this_rule == sum(1 for b in bits.values() if b == bit)
        assert r.kept_without == sum(1 for b in bits.values() if not b & ~bit)
        assert r.rejected == sum(1 for b in bits.values() if b) and r.docs == len(TEXTS)
    alone = {r.doc_id: r.sole_bit for r in quality.query(docs).collect()}
    assert alone == {i: b if b.bit_count() == 1 else 0 for i, b in bits.items()}


def test_keep_returns_the_rows_as_they_are(spark):
    docs = spark.createDataFrame([(1, TEXTS[5], "a", 3), (1, TEXTS[5], "b", 3), (2, "", "c", 0), (None, TEXTS[5], None, None)],
                                 "doc_id long, text string, source string, fail_bits int")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.source or "" for r in kept.collect()) == ["", "a", "b"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.query(docs).count() == 0
    assert {r.docs for r in quality.ablation(quality.ledger(docs)).collect()} == {0}
