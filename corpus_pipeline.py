"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.

- quality_rules drops documents that the policy rejects.
- simhash_near_dedup keeps the document with the smallest doc_id of each group.
- secret_scan replaces the secrets in texts, and keeps every document.
- source_mix puts the documents in the order of the mix, and keeps every one.
Defined cases, of all stages: null and empty texts have no words and go with the first; very long texts stay
whole; rows that repeat are judged one by one and are near-duplicates of each other afterwards, of which the one
with the smallest doc_id stays, rows without an id last and ties by text; null sources are a source of their own;
columns of any other names come along to the mix; an empty table gives no rows.

- byte_bpe returns (position, doc_id, source, n_tokens, ids, decoded_sha256): position is the document's place
  in the mix, as the files of its predecessor have it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.llm import bpe, mixing, quality, secrets, simhash
from quarry.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.tokenize(mixing.positioned(docs), path, public_tokenizers.PATTERN, keep=("source", "position"))
    return rows.select(
        "position",
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the fingerprints and tokens; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before left in the shared folder is removed on the way."""
    docs, start = table(spark, sf_dir, "documents"), storage.mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        storage.drop(start, keep=storage.last())
    return docs
