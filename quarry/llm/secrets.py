"""Secret scans, in DataFrame functions only.

Base kinds are patterns: ``assign`` (a key word, a separator and a value of 6+ characters), ``access``
(key ids of 20+ characters) and ``hex`` (24+ characters).  The method adds ``entropy``: candidate strings
of one character class, over which a window slides; the counts of its characters, and with them the sum
of c log2 c, change by one incoming and one outgoing character a step, and a candidate is a secret if
some window reaches the Shannon entropy that its class asks for.  Candidates that match the allow-list,
and those that overlap a base span, add nothing.

Offsets are code points, ends exclusive.  A pattern's matches come from regexp_extract_all, the text
between them from split with the same pattern, and running lengths of both give the offsets: everything
stays in one row, so there is no shuffle, and no text is cut.  Work is linear in a text's matches, but for sorting.

Defined cases: null and empty texts have no spans; very long texts are scanned whole, in their own row; of spans
that start together the kind listed first comes first; repeated rows are scanned one by one; an empty table
gives no rows; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, running

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: class -> (pattern of candidates, patterns that a candidate must all contain, least bits a character)
CLASSES: dict[str, tuple[str, tuple[str, ...], float]] = {
    "mixed": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+", ("[a-z]", "[A-Z]", "[0-9]"), 3.7),
    "upper": (r"(?<![A-Z0-9])[A-Z0-9]{20,}+", ("[A-Z]", "[0-9]"), 3.4),
}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|abcdefgh|qwerty|12345678|(.)\1{5}"
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _spans(text: Column, pattern: str, kind: int, good: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern's matches that are ``good``, in order."""

    def of_both(x: Column) -> Column:
        gap = lambda i: F.length(F.get(x["between"], i))
        sizes = F.transform(x["found"], lambda m, i: gap(i) + F.length(m))

        def placed(at: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                start = F.get(at, i) + gap(i)
                out = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("stop"))
                return F.when(good(m), out) if good else out

            return F.filter(F.transform(x["found"], span), lambda s: s.isNotNull())

        return F.when(F.size(x["found"]) > 0, let(running(sizes, "int", 0, lambda a, n: a + n), placed)).otherwise(_none())

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between")
    )
    return let(both, of_both)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits a character, of a window of a string; 0 if it is shorter."""

    def clog(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))

    def of_chars(chars: Column) -> Column:
        def of_alphabet(letters: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                come = F.array_position(letters, F.get(chars, i)).cast("int") - 1
                gone = F.when(i >= window, F.array_position(letters, F.get(chars, i - window)).cast("int") - 1)
                have = F.get(acc["n"], come)
                lost = F.get(acc["n"], gone) + F.when(gone == come, 1).otherwise(0)
                total = (
                    acc["sum"]
                    + clog(have + 1)
                    - clog(have)
                    + F.coalesce(clog(lost - 1) - clog(lost), F.lit(0.0))
                )
                return let(
                    total,
                    lambda t: F.struct(
                        F.transform(
                            acc["n"],
                            lambda c, j: c
                            + F.when(j == come, 1).otherwise(0)
                            - F.when(j == gone, 1).otherwise(0),
                        ).alias("n"),
                        t.alias("sum"),
                        F.when(
                            i >= window - 1, F.greatest(acc["best"], F.log2(F.lit(float(window))) - t / window)
                        )
                        .otherwise(acc["best"])
                        .alias("best"),
                    ),
                )

            return F.aggregate(
                F.sequence(F.lit(0), F.size(chars) - 1),
                F.struct(
                    F.transform(letters, lambda _: F.lit(0)).alias("n"),
                    F.lit(0.0).alias("sum"),
                    F.lit(0.0).alias("best"),
                ),
                step,
                lambda acc: acc["best"],
            )

        return let(F.array_distinct(chars), of_alphabet)

    return F.when(F.length(s) >= window, let(F.split(s, ""), of_chars)).otherwise(F.lit(0.0))


def _entropy_spans(text: Column) -> Column:
    per_class = []
    for pattern, needs, least in CLASSES.values():

        def good(m: Column, needs=needs, least=least) -> Column:
            ok = ~m.rlike(ALLOWED)
            for need in needs:
                ok = ok & m.rlike(need)
            return F.when(ok, window_entropy(m) >= least).otherwise(F.lit(False))

        per_class.append(F.when(text.rlike(pattern), _spans(text, pattern, 3, good)).otherwise(_none()))
    spans = F.sort_array(F.concat(*per_class))
    return let(spans, lambda x: F.filter(x, lambda s, i: (i == 0) | (s != F.get(x, i - 1))))


def _fresh(spans: Column) -> Column:
    """Sorted spans without those of the method that overlap a base span: one before, or the next after."""
    top = 2**31 - 1
    entropy = F.lit(KINDS.index("entropy"))
    stops = F.transform(spans, lambda s: F.when(s["kind"] < entropy, s["stop"]).otherwise(0))
    starts = F.transform(spans, lambda s: F.when(s["kind"] < entropy, s["start"]).otherwise(top))
    around = F.struct(
        running(stops, "int", 0, F.greatest).alias("before"),
        F.reverse(running(F.reverse(starts), "int", top, F.least)).alias("after"),
    )

    def apart(a: Column) -> Column:
        free = lambda s, i: (F.get(a["before"], i) <= s["start"]) & (F.get(a["after"], i) >= s["stop"])
        return F.filter(spans, lambda s, i: (s["kind"] < entropy) | free(s, i))

    return let(around, apart)


def _has(text: Column, parts: tuple[str, ...]) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(low, F.lit(p))
    return found


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind as an index of KINDS, stop).

    Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    assign = F.when(
        _has(t, ("password", "passwd", "secret", "token", "apikey", "api_key")), _spans(t, ASSIGN, 0, long_value)
    ).otherwise(_none())
    access = F.when(F.contains(t, F.lit("AKIA")), _spans(t, ACCESS, 1)).otherwise(_none())
    hexes = F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(_none())
    found = F.struct(
        F.sort_array(F.concat(assign, access, hexes)).alias("base"), _entropy_spans(t).alias("more")
    )

    def joined(x: Column) -> Column:
        return F.struct(x["base"].alias("base"), F.when(F.size(x["more"]) > 0, let(F.sort_array(F.concat(x["base"], x["more"])), _fresh)).otherwise(x["base"]).alias("spans"))

    out = docs.withColumn("_found", let(found, joined))
    return out.withColumns({"base": F.col("_found.base"), "spans": F.col("_found.spans")}).drop("_found")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def _runs(spans: Column) -> Column:
    """(start, stop) of maximal runs of sorted spans that overlap or touch."""

    def of_before(before: Column) -> Column:
        seen = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.get(before, i).alias("before")))
        first = F.filter(seen, lambda s: s["start"] > s["before"])
        last = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return let(first, lambda f: F.transform(f, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(f, i + 1)["before"], last).alias("stop"))))

    return let(running(F.transform(spans, lambda s: s["stop"]), "int", -1, F.greatest), of_before)


def _replaced(text: Column, spans: Column, mark: Column) -> Column:
    """A text with a mark for each run of its spans.

    A place in a text is found by counting from its start, so runs are taken in chunks, each with a piece of the text.
    """
    chunk = 512

    def of_runs(runs: Column) -> Column:
        def of_chunk(c: Column) -> Column:
            start = F.when(c == 0, 0).otherwise(F.get(runs, c * chunk - 1)["stop"])  # where the chunk before ends
            stop = F.get(runs, F.least(c * chunk + chunk, F.size(runs)) - 1)["stop"]

            def of_piece(x: Column) -> Column:
                def kept(r: Column, i: Column) -> Column:
                    a = F.when(i == 0, x["start"]).otherwise(F.get(x["own"], i - 1)["stop"])
                    return F.concat(F.substring(x["piece"], a - x["start"] + 1, r["start"] - a), mark)

                return F.array_join(F.transform(x["own"], kept), "")

            own = F.slice(runs, c * chunk + 1, F.lit(chunk))
            piece = F.substring(text, start + 1, stop - start)
            return let(F.struct(piece.alias("piece"), start.alias("start"), own.alias("own")), of_piece)

        chunks = F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / chunk).cast("int"))
        end = F.get(runs, F.size(runs) - 1)["stop"]
        return F.concat(F.array_join(F.transform(chunks, of_chunk), ""), F.substring(text, end + 1, F.length(text)))

    return let(_runs(spans), of_runs)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each maximal run of secret characters replaced, and ``n_chars`` made to agree."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    found = scan(row)
    out = _replaced(F.col("text"), F.col("spans"), F.lit(mark))
    found = found.withColumn("_t", F.when(F.size("spans") > 0, out).otherwise(F.col("text")))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("_t").alias(c))
        elif c == "n_chars":
            kind = dict(docs.dtypes)[c]
            cols.append(
                F.when(F.size("spans") > 0, F.length("_t").cast(kind)).otherwise(F.col("row").getField(c)).alias(c)
            )
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return found.select(*cols)


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


# Written apart from the above: patterns as specified, entropies by counting each window anew.
_FIND = """
  SELECT uid, '{kind}' AS kind, {at} AS k, m, CAST(sum(gap) OVER w + coalesce(sum(length(m)) OVER v, 0) AS BIGINT) AS s
  FROM (SELECT uid, i, f[i] AS m, length(g[i]) AS gap FROM (SELECT uid, f, g, unnest(range(1, len(f) + 1)) AS i FROM (
    SELECT uid, regexp_extract_all(t, '{pat}') AS f, regexp_split_to_array(t, '{pat}') AS g FROM d)))
  WINDOW w AS (PARTITION BY uid ORDER BY i ROWS UNBOUNDED PRECEDING),
    v AS (PARTITION BY uid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_WINDOWS = f"range(1, length(m) - {WINDOW - 2})"
_NEEDS = {"mixed": ("[a-z]", "[A-Z]", "[0-9]"), "upper": ("[A-Z]", "[0-9]")}
_CANDIDATES = {"mixed": "[A-Za-z0-9+/_-]{20,}", "upper": "[A-Z0-9]{20,}"}


def _entropy_sql(name: str) -> str:
    needs = " AND ".join(f"regexp_matches(m, '{n}')" for n in _NEEDS[name])
    counted = "list_sum(list_transform(map_values(list_aggregate(string_split(m[i:i + 19], ''), 'histogram')), lambda c: c * log2(c)))"
    return f"""SELECT uid, kind, k, m, s FROM ({_FIND.format(kind="entropy", at=3, pat=_CANDIDATES[name])}) WHERE {needs}
  AND NOT regexp_matches(m, '(?i)example|sample|dummy|placeholder|changeme|abcdefgh|qwerty|12345678')
  AND NOT list_bool_or(list_transform(range(1, length(m) - 4), lambda i: len(list_distinct(string_split(m[i:i + 5], ''))) = 1))
  AND list_max(list_transform({_WINDOWS}, lambda i: log2({WINDOW}) - {counted} / {WINDOW})) >= {CLASSES[name][2]}"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT * FROM ({_FIND.format(kind="assign", at=0, pat=_ASSIGN_SQL)}) WHERE length(regexp_extract(m, '{_ASSIGN_SQL}', 1)) >= 6),
c AS (SELECT * FROM ({_FIND.format(kind="access", at=1, pat="AKIA[A-Z0-9]+")}) WHERE length(m) >= 20),
h AS (SELECT * FROM ({_FIND.format(kind="hex", at=2, pat="[0-9a-f]+")}) WHERE length(m) >= 24),
base AS (SELECT uid, kind, k, s, s + length(m) AS e FROM (SELECT * FROM a UNION ALL SELECT * FROM c UNION ALL SELECT * FROM h)),
more AS (SELECT DISTINCT uid, kind, k, s, s + length(m) AS e FROM ({_entropy_sql("mixed")} UNION ALL {_entropy_sql("upper")})),
fresh AS (SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.uid = more.uid AND base.s < more.e AND more.s < base.e)),
b AS (SELECT uid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k, e) AS l FROM base GROUP BY uid),
x AS (SELECT uid, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, k, e) AS l FROM (SELECT * FROM base UNION ALL SELECT * FROM fresh) GROUP BY uid)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(b.l, '')) AS base_sha256, coalesce(x.l, '') AS spans
FROM d LEFT JOIN b USING (uid) LEFT JOIN x USING (uid)
"""
