"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures each text once and stores one bit per failed rule next to the measurements.
A policy is a version name with the mask of the bits it enforces: ``apply_policy`` and ``ablation``
read the ledger alone, so that a new policy never reads the texts again.

Limits are shares that prose stays clear of.  The one on words with letters (60 %) is between the two labels of
the sf0.1 test data: of labelled documents of ten words or more, no good one of any language has a lower share,
while poor ones go down to 49 %, and a twentieth of these have 51 % or less.

Defined cases: very long texts are measured whole, in their own row; a null or blank text has no words, fails ``few_words`` and is rejected; repeated rows
are judged one by one and stay; an empty table gives an empty ledger; other columns of the input are
ignored.  Equal 5-word windows are found by 64-bit hashes of their words.  All rules compare integers,
so ties (a share that is exactly at its limit) pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, words

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: name -> condition of failure over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
    "few_letters": "100 * n_alpha_words < 60 * n_words",
    "upper_case": "100 * n_upper > 50 * word_chars",
}
#: version -> enforced rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": tuple(RULES),
}


def mask(rules) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in set(rules))


def _repeat_words(hashes: Column) -> Column:
    """Number of words that lie in windows found twice or more; ``hashes`` has one hash per word."""

    def of_windows(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            twice = F.filter(
                s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            )
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                lambda acc, p: F.struct(
                    (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")
                ),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(order, of_sorted))

    windows = F.when(
        F.size(hashes) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return let(windows, of_windows)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, measurements): one pass over the texts, without a shuffle."""

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(joined, "[^A-Z]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(rows: Column) -> Column:
        return F.struct(
            F.size(rows).cast("long").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
        )

    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        let(words(t), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "w.*", "l.*", "n_symbols")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` (bit i: rule i of RULES failed), one row per document."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return measure(docs, text).withColumn("fail_bits", total.cast("long"))


def apply_policy(rows: DataFrame, version: str = "web-1") -> DataFrame:
    """Adds ``policy`` and ``kept``: no enforced bit is set."""
    return rows.withColumn("policy", F.lit(version)).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version]))) == 0
    )


def sole(rows: DataFrame, version: str = "web-1") -> Column:
    """The bit of the one enforced rule that a row fails; 0 if there is none, or more than one."""
    live = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[version])))
    return F.when(F.bit_count(live) == 1, live).otherwise(F.lit(0)).cast("long")


def ablation(rows: DataFrame, version: str = "web-1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is counted by its bits, map-side first, and all else is worked out from these counts with
    masks: at most 2 to the number of rules, whatever the number of documents.
    """
    every = mask(POLICIES[version])
    counts = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.collect_list(F.struct("fail_bits", "n")).alias("c"))

    def total(condition) -> Column:
        return F.aggregate(
            F.filter("c", lambda x: condition(x["fail_bits"])), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]
        )

    def anded(m: int):
        return lambda bits: bits.bitwiseAND(F.lit(m).cast("long"))

    per = [
        F.struct(
            F.lit(r).alias("rule"),
            total(lambda x, r=r: anded(mask([r]))(x) != 0).alias("failed"),
            total(lambda x, r=r: anded(every)(x) == mask([r])).alias("only_this_rule"),
            total(lambda x, r=r: anded(every & ~mask([r]))(x) == 0).alias("kept_without"),
        )
        for r in POLICIES[version]
    ]
    return one.select(
        total(lambda x: F.lit(True)).alias("docs"), total(lambda x: anded(every)(x) != 0).alias("rejected"), F.explode(F.array(*per)).alias("x")
    ).select(F.lit(version).alias("policy"), "x.*", "docs", "rejected")


def keep(docs: DataFrame, version: str = "web-1") -> DataFrame:
    """The documents that a policy keeps, with the columns of ``docs``; no join, no shuffle.

    The measurements ride along with the row, so that repeated ids cannot mix up.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc_id"), F.col("text"))
    kept = apply_policy(ledger(packed), version).where("kept")
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in own])


def query(docs: DataFrame) -> DataFrame:
    rows = apply_policy(ledger(docs), "web-1")
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base-1"]))) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits", sole(rows).alias("sole_bit"),
    )


_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_W} AS w FROM documents),
m AS (
  SELECT doc_id, len(w) AS n_words, array_to_string(w, '') AS joined,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words
  FROM d),
win AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
a AS (
  SELECT m.doc_id, n_words, length(joined) AS word_chars, n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_alpha_words,
    length(regexp_replace(joined, '[^A-Z]+', '', 'g')) AS n_upper, coalesce(cov.n, 0) AS n_repeat_words
  FROM m LEFT JOIN cov ON m.doc_id = cov.doc_id),
f AS (
  SELECT *, n_words < 10 AS f0, n_repeat_words * 5 > n_words AS f1, n_symbols * 10 > n_words AS f2, n_dup_lines * 5 > n_lines * 2 AS f3,
    word_chars > n_words * 12 OR word_chars < n_words * 2 AS f4, n_alpha_words * 5 < n_words * 3 AS f5, n_upper * 2 > word_chars AS f6
  FROM a)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept,
  CAST(if(f0, 1, 0) + if(f1, 2, 0) + if(f2, 4, 0) + if(f3, 8, 0) + if(f4, 16, 0) + if(f5, 32, 0) + if(f6, 64, 0) AS BIGINT) AS fail_bits,
  CAST(CASE list_count(list_filter([f0, f1, f2, f3, f4, f5, f6], lambda x: x)) WHEN 1 THEN
    CASE WHEN f0 THEN 1 WHEN f1 THEN 2 WHEN f2 THEN 4 WHEN f3 THEN 8 WHEN f4 THEN 16 WHEN f5 THEN 32 ELSE 64 END ELSE 0 END AS BIGINT) AS sole_bit
FROM f
"""
