import hashlib
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_quality import brute as measure
from test_secrets import base
from test_simhash import groups, slow_fingerprint

from quarry.llm import bpe, mixing
from quarry.llm.common import written

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(i):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % 20] + f"{(i + k) % 9}" for k in range(40))


TEXTS = {i: sentence(i) for i in range(24)} | {
    30: sentence(3), 31: None, 32: "", 33: "too short", 34: "Shti " * 80, 35: sentence(5) + " token = " + "0123456789abcdef" * 3,
    36: "x### y$$$ z%%% " * 30,
}


def test_run_matches_a_brute_force_version(spark, tmp_path):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in TEXTS.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {i: t for i, t in TEXTS.items() if not measure(t)[5] and not 10 * measure(t)[2] > measure(t)[0]}
    prints = {i: slow_fingerprint(t) for i, t in kept.items()}
    label = groups(sorted(set(prints.values())))
    first = {}
    for i in sorted(kept):
        first.setdefault(label[prints[i]], i)
    kept = {i: kept[i] for i in first.values()}
    enc = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}
    )
    assert set(got) == set(kept) and {31, 32, 33, 34, 36} & set(got) == set()
    for i, t in kept.items():
        spans = base(t)
        if spans:
            t = t[: spans[0][0]] + "[SECRET]" + t[max(e for _, _, e in spans) :]
        ids = enc.encode_ordinary(t)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert not re.search("0123456789abcdef", enc.decode(got[35].ids) if 35 in got else "")


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, sentence(1), "en", "a", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]


def test_the_mix_takes_effect_in_the_result(spark):
    rows = [(i, f"text {i} " * (i % 50), "en", "hot" if i % 5 else "s", 5) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = written(corpus_pipeline.source_mix(spark, docs, ""), "test-mix")
    got = sorted(corpus_pipeline.byte_bpe(spark, kept, "").collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(600))
    want = sorted(mixing.query(docs).collect(), key=lambda r: (r.slot, r.place))
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    share = {r.source: r.weight for r in want}
    last = min(max(i for i, r in enumerate(got) if r.source == s) for s in share) // mixing.BLOCK_ROWS
    for t in range(1, last):
        for s, w in share.items():
            n = sum(r.source == s for r in got[: t * mixing.BLOCK_ROWS])
            assert abs(n / mixing.BLOCK_ROWS - w * t) < 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, position int, file string, rank int, s string"


def test_defined_cases_of_all_stages(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, sentence(1)), (1, sentence(1)), (1, sentence(2)), (None, sentence(3)), (None, sentence(3)), (4, None), (5, ""), (6, long), (None, None)]
    docs = [(i, t, "en", None if n % 2 else "a", 1, n, "f", n, "s") for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1 for r in got)) == [-1, 1, 1, 6] and sorted(r.position for r in got) == [0, 1, 2, 3]
    enc = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={}
    )
    assert {enc.decode(r.ids) for r in got} == {sentence(1), sentence(2), sentence(3), long}
    kept = spark.createDataFrame(docs, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, ""), "test-stage")
        assert kept.columns == spark.createDataFrame(docs, SCHEMA).columns


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["position", "doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
