"""Lookups, listings and text scans over symbols and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import syntax
from quarry.functions import text as T
from quarry.operators.sizes import small
from quarry.storage import written


def exact(symbols: DataFrame, names: list[str], path: str | None = None) -> DataFrame:
    """Symbols of given names, in a file if one is given: pushed down to the scan."""
    out = symbols.where(F.col("name").isin(names))
    return out.where(F.col("file_path") == path) if path else out


def substring(symbols: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Names that contain a query, case-insensitively; _ and % in it are wildcards. Short names first."""
    out = symbols.where(F.col("name").ilike(f"%{query}%"))
    out = out.orderBy(F.length("name"), "name", "id")
    return out.limit(limit) if limit else out


def under(rows: DataFrame, scope: str, path: str = "file_path") -> DataFrame:
    """Rows of a file, or of any file below a directory; "" and "." are everything."""
    scope = scope.removeprefix("./").rstrip("/")
    if scope in ("", "."):
        return rows
    return rows.where((F.col(path) == scope) | F.col(path).startswith(scope + "/"))


def prefix_range(rows: DataFrame, prefix: str, path: str = "file_path") -> DataFrame:
    """Paths with a prefix as a range, which file and row-group statistics can prune; an empty one is everything."""
    head = prefix.rstrip(chr(0x10FFFF))
    rows = rows.where(F.col(path) >= prefix) if prefix else rows
    if not head:
        return rows
    after = ord(head[-1]) + 1
    return rows.where(F.col(path) < head[:-1] + chr(0xE000 if 0xD800 <= after < 0xE000 else after))


def symbols_in(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of a set of files (file_path), in the order of file and position."""
    return symbols.join(small(files.select("file_path").distinct()), "file_path", "left_semi").orderBy("file_path", "line", "id")


def overview(symbols: DataFrame) -> DataFrame:
    """One row a file: its number of symbols, and their kinds and names by line."""
    listed = F.sort_array(F.collect_list(F.struct("line", "id", F.concat("kind", F.lit(" "), "name").alias("t"))))
    return symbols.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_symbols"), F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("listing")
    )


def dir_stats(symbols: DataFrame) -> DataFrame:
    """(dir, files, symbols): counted per file first, so that one row a file is rolled up."""
    per_file = symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy(T.directory(F.col("file_path")).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("symbols")
    )


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """(id, line_no from 1, line)."""
    return files.select("id", F.posexplode(F.split(text, "\n")).alias("at", "line")).select(
        "id", (F.col("at") + 1).cast("long").alias("line_no"), "line"
    )


def file_slice(files: DataFrame, start: int, stop: int) -> DataFrame:
    """Lines [start, stop) counted from 0, as one text; clamped to the file."""
    rows = F.split("content", "\n")
    return files.select(
        "id", F.array_join(F.slice(rows, start + 1, stop - start), "\n").alias("slice"), F.size(rows).cast("long").alias("total_lines")
    )


def list_dir(files: DataFrame, parent: str = "") -> DataFrame:
    """(name, kind, size) of what is directly in a directory."""
    base = parent.rstrip("/") + "/" if parent else ""
    inside = files.where(F.col("relative_path").startswith(base)) if base else files
    rest = F.substring(F.col("relative_path"), len(base) + 1, 1 << 30)
    name = F.split(rest, "/")[0]
    return inside.groupBy(name.alias("name"), F.when(F.contains(rest, F.lit("/")), "dir").otherwise("file").alias("kind")).agg(
        F.sum("size_bytes").alias("size_bytes")
    )


def find_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name or path matches a glob."""
    regex = T.glob_regex(pattern)
    path = F.col("relative_path")
    return files.where(F.element_at(F.split(path, "/"), -1).rlike(regex) | path.rlike(regex))


def grep(files: DataFrame, pattern: str, context: int = 1) -> DataFrame:
    """The first match in each line: line and byte column from 1, the trimmed line, lines around it."""
    rows = F.split("content", "\n")
    hits = F.filter(
        F.transform(rows, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"))),
        lambda x: x["line"].rlike(pattern),
    )
    found = files.where(F.col("content").rlike(pattern)).select("id", rows.alias("rows"), F.explode(hits).alias("m"))
    head = F.split("m.line", pattern, 2)[0]
    start = F.greatest(F.col("m.line_no") - context, F.lit(1)).cast("int")
    return found.select(
        "id",
        "m.line_no",
        (F.octet_length(head) + 1).cast("long").alias("column"),
        F.trim("m.line").alias("line"),
        F.array_join(F.slice("rows", start, (F.col("m.line_no") + context - start + 1).cast("int")), "\n").alias("context"),
    )


def substring_with_path(symbols: DataFrame, query: str, scope: str, limit: int = 0) -> DataFrame:
    """Names that contain a query, in a file or below a directory."""
    return substring(under(symbols, scope), query, limit)


def code_lines(files: DataFrame) -> DataFrame:
    """(id, line_no, line, code): lines, and each without its strings and comments, which are blank; by the file's type."""
    ext = T.extension(F.col("relative_path")) if "relative_path" in files.columns else F.lit("")
    rows = files.select("id", F.split("content", "\n").alias("line"), F.split(syntax.mask(F.col("content"), ext), "\n").alias("code"))
    rows = rows.select("id", F.posexplode(F.arrays_zip("line", "code")).alias("at", "x"))
    return rows.select("id", (F.col("at") + 1).cast("long").alias("line_no"), "x.line", "x.code")


def word_matches(files: DataFrame, word: str) -> DataFrame:
    """Per line the number of whole-word occurrences of an identifier, outside strings and comments."""
    rows = code_lines(files.where(F.contains(F.col("content"), F.lit(word))))
    n = F.regexp_count("code", F.lit(rf"\b{re.escape(word)}\b")).cast("long")
    return rows.select("id", "line_no", n.alias("matches")).where("matches > 0")


#: Lines that start a test, in several languages.
TESTS = r"^\s*(?:(?:async )?def test_|(?:pub )?fn test_|#\[(?:tokio::)?test\]|(?:it|test|describe)\(|func Test)"


def find_tests(files: DataFrame) -> DataFrame:
    """(id, line_no, line): lines that start a test or carry its mark."""
    return lines(files.where(F.col("content").rlike("(?m)" + TESTS))).where(F.col("line").rlike(TESTS))


def annotations(files: DataFrame) -> DataFrame:
    """(id, line_no, tag, message): a line appears once for each tag that it holds."""
    any_tag = rf"\b({'|'.join(T.TAGS)})\b"
    rows = lines(files.where(F.col("content").rlike(any_tag))).where(F.col("line").rlike(any_tag))
    tagged = rows.select("*", F.explode(F.array(*[F.lit(t) for t in T.TAGS])).alias("tag"))
    pattern = F.concat(F.lit(r"\b"), "tag", F.lit(r"\b[:\s]*(.*)$"))
    return tagged.where(F.regexp_like("line", F.concat(F.lit(r"\b"), "tag", F.lit(r"\b")))).select(
        "id", "line_no", "tag", F.trim(F.regexp_extract_all("line", pattern, 1)[0]).alias("message")
    )


def stabbed(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (file_path, at, ...) with the spans (file_path, start, stop, ...) of their file that hold them.

    A span lies in the one or two cells of the least power of two above its width, and a point looks into one
    cell of each width that occurs, so that both meet by equality: spans side by side never meet the points of
    each other beyond their neighbours, however many a file has.
    """
    spans = spans.where("start <= stop").withColumn("_level", F.length(F.bin(F.col("stop") - F.col("start"))))
    levels = spans.agg(F.collect_set("_level").alias("_levels"))  # one row, 64 values at most
    cells = F.sequence(F.expr("shiftright(start, _level)"), F.expr("shiftright(stop, _level)"))
    probes = points.crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).drop("_levels")
    probes = probes.withColumn("_cell", F.expr("shiftright(at, _level)"))
    hit = probes.join(spans.withColumn("_cell", F.explode(cells)), ["file_path", "_level", "_cell"])
    return hit.where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("stop"))).drop("_level", "_cell")


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (point_id, file_path, at) with the smallest span (span_id, start, stop) around it.

    Among the spans that hold a point the least is kept by a partially combined minimum.
    """
    at = points.select("point_id", "file_path", F.col("at").cast("long").alias("at"))
    long_ = spans.withColumns({c: F.col(c).cast("long") for c in ("start", "stop")})
    best = stabbed(at, long_).groupBy("point_id").agg(
        F.min(F.struct((F.col("stop") - F.col("start")).alias("width"), "start", "span_id")).alias("m")
    )
    return points.join(best, "point_id", "left").select(*points.columns, F.col("m.span_id").alias("span_id"))


def complexity(files: DataFrame, spans: DataFrame | None = None, most: int = 50) -> DataFrame:
    """1 + branch words and operators: of each file, or of each symbol's lines (id, span_id, start, stop), at most ``most``."""
    words = r"\b(if|elif|for|while|catch|except|case|and|or)\b"
    body, keys = F.col("content"), ["id"]
    if spans is not None:
        files, keys = files.join(spans, "id"), ["id", "span_id"]
        size = F.least(F.col("stop") - F.col("start") + 1, F.lit(most)).cast("int")
        body = F.array_join(F.slice(F.split("content", "\n"), F.col("start").cast("int"), size), "\n")
    n = F.regexp_count(body, F.lit(words)) + F.regexp_count(body, F.lit(r"&&|\|\|"))
    return files.select(*keys, (n + 1).cast("long").alias("complexity"))


# Languages by extension, and what makes a path a test or generated, or a symbol exported.
LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "py": "python", "go": "go", "java": "java", "rb": "ruby", "swift": "swift", "kt": "kotlin",
    "kts": "kotlin", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "c": "c", "h": "c",
}
TEST_FOLDERS = "(/tests?/)|(^tests?/)|(/integration_tests/)"
TEST_FILES = r"(_test\.rs|\.test\.tsx?|\.spec\.ts|_spec\.rb|_test\.go)$"
GENERATED_FOLDERS = r"/generated/|\.generated\.|/build/|/target/"
GENERATED_FILES = r"(\.g\.rs|\.pb\.rs|\.pb\.go)$"
EXPORTED = r"^(pub |pub\(|export |public )"
EXPORTED_KINDS = ("interface", "type_alias", "enum")


def properties(path: Column, signature: Column, kind: Column) -> dict[str, Column]:
    """What a path and a signature say: language, module, test, generated, exported."""
    p = F.lower(path)
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return {
        "language": F.coalesce(known[T.extension(path)], F.lit("other")),
        "module_path": F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.[^.]*$", ""), "^.*?/src/", ""), "/", "::"),
        "is_test": p.rlike(TEST_FOLDERS) | p.rlike(TEST_FILES),
        "is_generated": p.rlike(GENERATED_FOLDERS) | p.rlike(GENERATED_FILES),
        "exported": F.trim(signature).rlike(EXPORTED) | kind.isin(*EXPORTED_KINDS),
    }


def described(symbols: DataFrame) -> DataFrame:
    """The properties of each symbol (id, file_path, signature, kind)."""
    found = properties(F.col("file_path"), F.col("signature"), F.col("kind"))
    return symbols.select("id", *[c.alias(name) for name, c in found.items()])


def first_wins(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """Union with the first source per key: the row with the least priority."""
    by = Window.partitionBy(key).orderBy(priority)
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key is not among them."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def keep_children(children: DataFrame, old: DataFrame, new: DataFrame, key: str, hash: str) -> DataFrame:
    """Children whose parent is as it was: those of parents that are gone or have another hash go, with a replaced file's rows.

    Children of parents that the old state does not know have nothing to be deleted with, and stay.
    """
    same = new.select(key, hash)
    gone = old.select(key, hash).join(same, [key, hash], "left_anti").select(key)
    return children.join(gone, key, "left_anti")


def failures(events: DataFrame) -> DataFrame:
    """(file, failed_at, retries): files whose last failure (ts, failed) is not cleared by a later success (ts, done)."""
    rows = events.groupBy("file").agg(
        F.max(F.when(F.col("failed"), F.col("ts"))).alias("failed_at"),
        F.count_if("failed").alias("retries"),
        F.max(F.when(F.col("done"), F.col("ts"))).alias("cleared_at"),
    )
    return rows.where((F.col("retries") > 0) & (F.col("cleared_at").isNull() | (F.col("cleared_at") < F.col("failed_at")))).drop("cleared_at")


def failure_summary(log: DataFrame, since: Column, often: int = 3) -> DataFrame:
    """How many files have failed: in all, since a moment, so many times, and neither."""
    recent, many = F.col("failed_at") >= since, F.col("retries") >= often
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(recent).alias("recent"), F.count_if(many).alias("persistent"), F.count_if(~recent & ~many).alias("stale")
    )


def one_sided(defined: DataFrame, dispatched: DataFrame, key: str) -> DataFrame:
    """(side, key): names that only one of two surfaces has."""
    a, b = defined.select(key).distinct(), dispatched.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("only_defined").alias("side"), key).unionAll(
        b.join(a, key, "left_anti").select(F.lit("only_dispatched").alias("side"), key)
    )


def coverage(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files by readiness (key, hash on both sides): ready, stale, missing or extra, with a percentage."""
    both = wanted.select("key", F.col("hash").alias("w")).join(indexed.select("key", F.col("hash").alias("i")), "key", "full")
    state = (
        F.when(F.col("w").isNull(), "extra").when(F.col("i").isNull(), "missing").when(F.col("w") == F.col("i"), "ready").otherwise("stale")
    )
    c = lambda s: F.count_if(state == s).alias(s)
    sums = both.agg(c("ready"), c("stale"), c("missing"), c("extra"))
    checked = F.col("ready") + F.col("stale") + F.col("missing")
    return sums.withColumn(
        "percent", F.when(checked > 0, F.floor(F.col("ready") * 100 / checked)).otherwise(0).cast("long")
    )


def redundant_wrappers(files: DataFrame) -> DataFrame:
    """(id, line_no, name, target): one-line functions that only forward to another, but in test files and from a test section on."""
    pattern = r"^[ \t]*(?:pub +)?(?:fn|def|function) +(\w+)\([^)\n]*\)[^{:\n]*[{:][ \t]*(?:return +)?(?:self\.)?(\w+)\([^)\n]*\);?[ \t]*}?[ \t]*$"
    code = files.where(~T.is_test_path(F.col("relative_path"))).where(F.col("content").rlike("(?m)" + pattern))
    body = F.split("content", r"(?m)^\s*#\[cfg\(test\)\]", 2)[0]
    rows = lines(code.select("id", body.alias("content"))).where(F.col("line").rlike(pattern))
    hits = rows.select("id", "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("target"))
    return hits.where("name <> target")


def phantom_modules(files: DataFrame) -> DataFrame:
    """Declared modules (``mod x;``) that no path has as a segment, but tests."""
    declared = files.select(
        F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"), 1)).alias("module"), "relative_path"
    )
    stems = files.select(
        F.explode(F.split(F.regexp_replace("relative_path", r"\.[^./]*$", ""), "/")).alias("module")
    ).distinct()
    return declared.where(~F.col("module").rlike("^tests?$|_tests?$")).join(stems, "module", "left_anti")


def word_at(files: DataFrame, points: DataFrame) -> DataFrame:
    """(id, line_no, column, word): the identifier at each point (id, line_no, column from 1), if there is one."""
    rows = lines(files).join(points, ["id", "line_no"])
    head = F.regexp_extract(F.substring(F.col("line"), F.lit(1), F.col("column") - 1), "[A-Za-z0-9_]*$", 0)
    tail = F.regexp_extract(F.substring(F.col("line"), F.col("column"), F.length("line")), "^[A-Za-z0-9_]*", 0)
    return rows.select("id", "line_no", "column", F.concat(head, tail).alias("word")).where("word <> ''")


def text_references(files: DataFrame, symbols: DataFrame, name: str, spans: DataFrame | None = None) -> DataFrame:
    """(id, line_no, matches, is_declaration, enclosing): occurrences of a name; a line that declares it is marked.

    ``symbols``: (id of the file, name, line).  Files that declare a name of their own while not being the
    first that does shadow it, and are left out.  ``spans`` (id, span_id, start, stop) has what may enclose a line.
    """
    decl = symbols.where(F.col("name") == name).select("id", F.col("line").alias("line_no"), F.lit(True).alias("d")).distinct()
    first = decl.agg(F.min("id").alias("first"))
    shadow = decl.crossJoin(F.broadcast(first)).where("id <> first").select("id").distinct()  # one row
    hits = word_matches(files, name).join(shadow, "id", "left_anti").join(decl, ["id", "line_no"], "left")
    hits = hits.select("id", "line_no", "matches", F.coalesce("d", F.lit(False)).alias("is_declaration"))
    if spans is None:
        return hits.withColumn("enclosing", F.lit(None).cast("long"))
    points = hits.select("*", F.xxhash64("id", "line_no").alias("point_id"), F.col("id").alias("file_path"), F.col("line_no").alias("at"))
    found = enclosing(points, spans.withColumnRenamed("id", "file_path"))
    return found.select("id", "line_no", "matches", "is_declaration", F.col("span_id").alias("enclosing"))


def decorated(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, line_no): symbol lines (id, line_no) whose nearest line above that is not blank starts with @."""
    by = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(files).withColumn("above", F.last(F.when(F.trim("line") != "", F.trim("line")), ignorenulls=True).over(by))
    return rows.where(F.col("above").startswith("@")).select("id", "line_no").join(symbols, ["id", "line_no"], "left_semi")


def nested(symbols: DataFrame) -> DataFrame:
    """(file_path, id, parent_id): the smallest other symbol of the file whose byte range contains a symbol's.

    An id is one symbol's.  Symbols of equal ranges have equal parents and are never each other's, so that ranges meet
    and not symbols: each once, with its least symbol.
    """
    start, end = F.col("start_byte").cast("long"), F.col("end_byte").cast("long")
    ranges = symbols.groupBy("file_path", start.alias("start"), end.alias("stop")).agg(F.min("id").alias("parent_id"))
    inner = ranges.select("file_path", F.col("start").alias("at"), F.col("stop").alias("end"))
    hit = stabbed(inner, ranges).where("stop >= end AND (start < at OR stop > end)")
    best = hit.groupBy("file_path", "at", "end").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("w"), F.col("parent_id"))).alias("m"))
    rows = symbols.select("file_path", "id", start.alias("at"), end.alias("end"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("file_path", "at", "end")]
    return rows.alias("s").join(best.alias("b"), same, "left").select("s.file_path", "s.id", F.col("m.parent_id").alias("parent_id"))


def name_paths(tree: DataFrame, names: DataFrame, max_rounds: int = 16) -> DataFrame:
    """(id, name_path) from (id, parent_id) and (id, name), at any depth: each round doubles the levels that a path has.

    A parent that is not a row ends a path; a cycle of parents is an error.
    """
    rows = written(tree.select("id", "parent_id").join(names, "id").select("id", F.col("name").alias("path"), F.col("parent_id").alias("up")), "name-paths")
    for _ in range(max_rounds):
        if rows.where("up IS NOT NULL").isEmpty():
            return rows.select("id", F.col("path").alias("name_path"))
        above = rows.select(F.col("id").alias("up"), F.col("path").alias("head"), F.col("up").alias("next"))
        rows = written(
            rows.join(above, "up", "left").select("id", F.concat_ws("/", "head", "path").alias("path"), F.col("next").alias("up")), "name-paths"
        )
    raise ValueError(f"more than {2**max_rounds} levels, or parents that go round in a circle")


def cursor(rows: DataFrame, order: list[str], offset: int) -> str:
    """A place in a listing: an offset with the listing's number of rows and a fingerprint of them."""
    n, mark = rows.agg(F.count(F.lit(1)), F.hex(F.bit_xor(F.xxhash64(*order)))).first()
    return f"{offset}.{n}.{mark}"


def page(rows: DataFrame, order: list[str], token: str, size: int) -> DataFrame:
    """``rows`` from a cursor on, with their place from 0; a cursor that was made for another listing is an error."""
    offset = int(token.split(".")[0])
    if cursor(rows, order, offset) != token:
        raise ValueError("the listing has changed since the cursor was made")
    first = rows.orderBy(*order).limit(offset + size)  # what is before the page comes along, and is dropped again
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return first.withColumn("place", place.cast("long")).where(F.col("place") >= offset)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in an order: dealt by ranges and sorted there, not in one task."""
    sorted_ = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = sorted_.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = counts.select("_p", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("long").alias("_base"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    out = sorted_.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(base), "_p")
    return out.withColumn("place", F.col("_base") + inside).drop("_p", "_m", "_base")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by an order: what a replacing insert leaves."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("m"))
    return best.select(*keys, "m.*")


def hashed_vectors(rows: DataFrame, size: int = 64) -> DataFrame:
    """(id, embedding): a unit vector of signed hashed tokens; stands in where no model is at hand."""

    def summed(h: Column) -> Column:
        sign = F.transform(h, lambda x: F.when(x < 0, -1.0).otherwise(1.0))
        signed = F.struct(F.transform(h, lambda x: F.pmod(x, F.lit(size))).alias("p"), sign.alias("s"))
        at = lambda t, i: F.aggregate(F.zip_with(t["p"], t["s"], lambda a, b: F.when(a == i, b).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
        return T.let(signed, lambda t: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: at(t, i)))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return T.let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    # each step once a row: as columns of their own they would be put into each other, once an element
    hashes = F.transform(T.tokens(F.col("text")), lambda t: F.xxhash64(t))
    return rows.select("id", T.let(T.let(hashes, summed), unit).alias("embedding"))
