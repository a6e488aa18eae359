"""The opN queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, cobucket, embeddings, lm, mixing, quality, secrets, simhash, suffix_dedup, token_files, vector_codes, warc
from quarry.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": _over("documents", suffix_dedup.query),
        "op2_quality_rules": _over("documents", quality.query),
        "op3_byte_bpe": _over("documents", bpe.query),
        "op4_simhash_near_dedup": _over("documents", simhash.query),
        "op5_secret_scan": _over("documents", secrets.query),
        "op6_chat_format": _over("conversations", chat.query),
        "op7_lm_score": _over("documents", lm.query),
        "op8_source_mix": _over("documents", mixing.query),
        "op9_warc": _over("pages", warc.query),
        "op10_embedding_near_dedup": _over("embeddings", embeddings.query),
        "op11_token_files": _over("documents", token_files.query),
        "op12_vector_codes": _over("embeddings", vector_codes.query),
        "op13_cobucket": cobucket.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE_SQL,
        "op5_secret_scan": secrets.ORACLE_SQL,
        "op6_chat_format": chat.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
        "op10_embedding_near_dedup": embeddings.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
