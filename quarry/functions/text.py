"""Identifiers, tokens, paths and score rules as Column expressions: no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These have to equal the reference's for equal results.
STOPWORDS = (
    "the", "for", "with", "from", "that", "this", "into", "onto", "over", "not", "and", "any", "all", "are",
    "was", "were", "has", "have", "had", "how", "what", "when", "where", "which", "who", "why", "but", "its",
    "can", "use", "using", "used", "gets", "set", "sets", "new", "let",
)
BODY_STOPWORDS = (
    "fn", "let", "mut", "pub", "use", "mod", "if", "else", "for", "while", "loop", "match", "return", "self",
    "true", "false", "as", "in", "of", "the", "and", "or", "not", "is", "this", "that", "ok", "err", "none",
    "some", "result",
)
VERBS = (
    "find", "get", "search", "detect", "start", "run", "read", "write", "move", "change", "rename", "replace",
    "extract", "route", "embed", "build", "create", "delete", "update", "compute", "calculate", "apply",
    "handle", "parse", "index", "watch", "listen", "fetch", "send", "load", "save", "open", "close", "connect",
    "check", "validate", "verify", "transform", "convert", "process", "execute", "call", "invoke", "inline",
    "refactor", "analyze", "import", "export",
)
NOISE_CALLEES = (
    "get", "set", "push", "pop", "len", "from", "into", "map", "filter", "collect", "contains", "insert",
    "remove", "format", "print", "clone", "default", "next", "read", "write", "open", "close", "keys",
    "values", "sort", "reverse", "find", "replace", "delete", "add", "clear", "of", "size", "copy",
    "is_empty", "to_string", "to_owned", "as_str", "as_ref", "unwrap", "expect", "ok", "err", "and_then",
    "or_else", "unwrap_or", "unwrap_or_else", "unwrap_or_default", "iter", "into_iter", "take", "skip",
    "println", "eprintln", "drop", "enter", "lock", "cloned", "range", "enumerate", "zip", "sorted",
    "reversed", "isinstance", "issubclass", "hasattr", "getattr", "setattr", "delattr", "type", "super",
    "str", "int", "float", "bool", "list", "dict", "tuple", "frozenset", "bytes", "bytearray", "repr", "abs",
    "min", "max", "sum", "any", "all", "ord", "chr", "hex", "oct", "bin", "hash", "id", "input", "vars",
    "dir", "help", "round", "append", "extend", "update", "items", "join", "split", "strip", "startswith",
    "endswith", "encode", "decode", "upper", "lower", "log", "warn", "error", "info", "debug", "toString",
    "valueOf", "JSON", "parse", "stringify", "assign", "entries", "forEach", "reduce", "findIndex", "some",
    "every", "includes", "indexOf", "slice", "splice", "concat", "flat", "flatMap", "fill", "isArray",
    "Promise", "resolve", "reject", "then", "catch", "finally", "setTimeout", "setInterval", "clearTimeout",
    "clearInterval", "parseInt", "parseFloat", "isNaN", "isFinite", "require", "make", "cap", "panic",
    "recover", "real", "imag", "complex", "Println", "Printf", "Sprintf", "Fprintf", "Errorf", "New",
    "equals", "hashCode", "compareTo", "getClass", "notify", "notifyAll", "wait", "isEmpty", "addAll",
    "containsKey", "containsValue", "put", "putAll", "entrySet", "keySet", "charAt", "substring", "trim",
    "length", "toArray", "stream", "asList",
)
STRUCTURED_TYPES = ("yml", "yaml", "json", "toml", "lock", "md", "cfg", "ini")
TAGS = ("TODO", "FIXME", "HACK", "DEPRECATED", "XXX", "NOTE")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def symbol_id(path: Column, kind: Column, name_path: Column) -> Column:
    return F.concat(path, F.lit("#"), kind, F.lit(":"), name_path)


def parse_symbol_id(ident: Column) -> Column:
    """(path, kind, name_path), or null unless all three are there."""
    path = F.regexp_extract(ident, r"^([^#]+)#([^:]+):(.+)$", 1)
    return F.when(
        path != "",
        F.struct(
            path.alias("file_path"),
            F.regexp_extract(ident, r"^([^#]+)#([^:]+):(.+)$", 2).alias("kind"),
            F.regexp_extract(ident, r"^([^#]+)#([^:]+):(.+)$", 3).alias("name_path"),
        ),
    )


def split_identifier(name: Column) -> Column:
    """Camel and snake case as words; a run of capitals stays together."""
    spaced = F.regexp_replace(name, "[_-]+", " ")
    spaced = F.regexp_replace(spaced, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2"))


def embedding_text(kind: Column, name: Column, name_path: Column, path: Column, signature: Column) -> Column:
    """What stands for a symbol in vector search: kind, name with its words, owner, folder, file and signature."""
    words = split_identifier(name)
    owner = F.regexp_extract(name_path, "^(.+)/[^/]*$", 1)
    folder = F.regexp_extract(path, "([^/]+)/[^/]*$", 1)
    base = F.concat(
        kind,
        F.lit(" "),
        F.when(words != name, F.concat(name, F.lit(" ("), words, F.lit(")"))).otherwise(name),
        F.when(owner != "", F.concat(F.lit(" (in "), owner, F.lit(")"))).otherwise(""),
        F.when((folder != "") & ~folder.isin("src", "crates"), F.concat(F.lit(" ["), folder, F.lit("]"))).otherwise(""),
        F.when(path != "", F.concat(F.lit(" in "), F.element_at(F.split(path, "/"), -1))).otherwise(""),
    )
    return F.when(signature != "", F.concat(base, F.lit(": "), signature)).otherwise(base)


#: What may start a line of a comment above a symbol.
COMMENT = r"^\s*(?:///?!?|#!?|\*|/\*\*?)\s?"


def leading_doc(rows: Column, line: Column) -> Column:
    """The comment lines right above a line (from 1) of a file's lines, without their marks, joined by spaces."""
    above = F.reverse(F.slice(rows, 1, F.greatest(line - 1, F.lit(0)).cast("int")))
    state = F.aggregate(
        above,
        F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            (acc["on"] & x.rlike(COMMENT)).alias("on"),
            F.when(acc["on"] & x.rlike(COMMENT), F.concat(F.array(F.trim(F.regexp_replace(x, COMMENT, ""))), acc["out"])).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.array_join(state["out"], " ")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and _, each followed by its parts; one-character ones are left out."""
    runs = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0), lambda x: F.length(x) >= 2)

    def with_parts(run: Column) -> Column:
        parts = F.filter(F.split(run, "_"), lambda p: F.length(p) >= 2)
        return F.when(F.contains(run, F.lit("_")), F.concat(F.array(run), parts)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, with_parts))


def lexical_tokens(text: Column, limit: int = 300) -> Column:
    """The first distinct lower-case tokens of two or more characters, space-joined."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), 0)
    return F.array_join(F.slice(F.array_distinct(found), 1, limit), " ")


def query_tokens(query: Column) -> Column:
    """Distinct query words of three or more characters that are not stopwords, in order."""
    words = F.split(F.lower(query), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS)))


def snake(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s-]", "_")


def has_word(text: Column, word: Column) -> Column:
    """Whole-word match, with _ as a boundary."""
    return F.regexp_like(
        F.lower(text), F.concat(F.lit("(^|[^0-9a-z])"), F.lower(word), F.lit("([^0-9a-z]|$)"))
    )


def glob_regex(pattern: str) -> str:
    special = set(".^$+{}[]()|\\")
    return "^" + "".join(
        ".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern
    ) + "$"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def directory(path: Column) -> Column:
    """Up to the last slash inclusive; "." without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*/)", 1)).otherwise(F.lit("."))


def duplicate_threshold(base: float, path_a: Column, path_b: Column) -> Column:
    """A base threshold, raised to .95 where either file is structured text."""
    floor = lambda p: F.when(extension(p).isin(*STRUCTURED_TYPES), F.lit(0.95)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(base), floor(path_a), floor(path_b))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|__tests__|spec)(/|$)|_test\.|\.test\.|\.spec\.|(^|/)test_")


# What makes a symbol a test: its path, its name path, marks in the bytes before it, its name.
TEST_SYMBOL_PATH = (
    r"/tests/|_tests\.rs$|/__tests__/|_test\.py$|_test\.go$|\.test\.(ts|tsx|js|jsx)$|\.spec\.(ts|js)$|/src/test/|Tests?\.java$|_test\.rb$|/spec/"
)
TEST_SYMBOL_OWNER = r"^tests?::|::tests?::"
TEST_MARKS = r"#\[test\]|#\[tokio::test\]|#\[cfg\(test\)\]|#\[cfg\(all\(test"
JVM_TEST_MARKS = "@Test|@ParameterizedTest|@RepeatedTest"
MARK_WINDOW, JVM_MARK_WINDOW = 2048, 200


def is_test_symbol(path: Column, name: Column, name_path: Column, kind: Column, source: Column, start: Column) -> Column:
    """Whether a symbol that starts at a byte of its file's text is a test, or only there for tests."""
    raw = source.cast("binary")

    def before(window: int) -> Column:
        at = F.greatest(start - window, F.lit(0))
        return F.coalesce(F.substring(raw, (at + 1).cast("int"), (start - at).cast("int")).cast("string"), F.lit(""))

    by_name = (path.endswith(".py") & (name.startswith("test_") | ((kind == "class") & name.startswith("Test")))) | (
        path.endswith(".go") & name.startswith("Test") & (kind == "function")
    )
    jvm = path.rlike(r"\.(java|kt)$") & before(JVM_MARK_WINDOW).rlike(JVM_TEST_MARKS)
    inside = before(MARK_WINDOW).rlike(TEST_MARKS) | (source.isNotNull() & (by_name | jvm))
    return path.rlike(TEST_SYMBOL_PATH) | name_path.rlike(TEST_SYMBOL_OWNER) | F.coalesce(inside, F.lit(False))


# Roles of paths, the first rule that holds; of the folder after the last src, the file's name, and the package before src.
TEST_PATH = r"/tests/|/tests\.|_tests\.rs$|/integration_tests/|/test_helpers"
BENCHMARK_PATH = "^(benchmarks|scripts|models)/"
TOOL_FOLDERS = ("tools",)
SURFACE_FOLDERS, SURFACE_FILES, SURFACE_PACKAGES = ("ui", "tui", "cli", "app"), ("ui.rs", "tui.rs", "cli.rs", "app.rs"), "[-_](ui|tui|cli|app)$"
INFRASTRUCTURE_FOLDERS = ("dispatch", "server", "runtime", "transport")
INFRASTRUCTURE_FILES, INFRASTRUCTURE_PACKAGES = ("protocol.rs", "transport.rs", "runtime.rs"), "[-_]mcp$"


def provenance(path: Column) -> Column:
    """Role of a path: test, benchmark, tool, surface, infrastructure or core."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    after = F.regexp_extract(p, "^(?:.*/)?src/([^/]+)", 1)
    package = F.regexp_extract(p, "^(?:.*/)?([^/]+)/src/", 1)
    name = F.element_at(F.split(p, "/"), -1)
    surface = after.isin(*SURFACE_FOLDERS) | name.isin(*SURFACE_FILES) | package.rlike(SURFACE_PACKAGES)
    inner = after.isin(*INFRASTRUCTURE_FOLDERS) | name.isin(*INFRASTRUCTURE_FILES) | package.rlike(INFRASTRUCTURE_PACKAGES)
    return (
        F.when(p.rlike(TEST_PATH), "test")
        .when(p.rlike(BENCHMARK_PATH), "benchmark")
        .when(after.isin(*TOOL_FOLDERS), "tool")
        .when(surface, "surface")
        .when(inner, "infrastructure")
        .otherwise("core")
    )


def body_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII words of two or more characters that are not keywords."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*BODY_STOPWORDS)))


def is_noise_callee(name: Column, language: Column) -> Column:
    """Calls that say nothing about a program's structure; a Rust ``new`` does."""
    return name.isin(*NOISE_CALLEES) & ~((language == "rs") & (name == "new"))


# Files in which unlike symbols are normal, by name and folder.
TEST_ROLE = r"(^|/)tests\.rs$|_tests?\.rs$|(^|/)tests?(/|$)"
ENTRY_ROLE = r"(^|/)(mod|lib)\.rs$|(^|/)(main|index)\.[^/]*$"
HANDLER_ROLE = r"(^|/)handlers\.rs$|_handlers?\.rs$"


def role_boost(path: Column) -> Column:
    """Structural role of a file: tests and entry points .15, handlers .10."""
    p = F.lower(path)
    return F.when(p.rlike(TEST_ROLE) | p.rlike(ENTRY_ROLE), F.lit(0.15)).when(p.rlike(HANDLER_ROLE), F.lit(0.10)).otherwise(F.lit(0.0))


def change_kind(status: Column, deletions: Column) -> Column:
    """New files add, deleted ones break; all others, renamed ones too, add if they delete no line."""
    return F.when(status.isin("A", "?"), "additive").when(status == "D", "breaking").when(deletions == 0, "additive").otherwise("mixed")


def confidence(coverage: Column, hit: Column, terms: Column) -> Column:
    return (
        F.when((coverage >= 0.8) & hit, "high").when(hit | (terms >= 2), "medium").otherwise("low")
    )


def follow_up(kind: Column, exported: Column) -> Column:
    """Suggested next operations, comma-joined."""
    return (
        F.when(kind.isin("function", "method") & exported, "callers,impact,body")
        .when(kind.isin("function", "method"), "callers,body")
        .when(kind.isin("class", "interface", "enum"), "overview,hierarchy")
        .otherwise("references")
    )


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    """Bytes [start, stop) of a text's UTF-8, decoded."""
    return F.substring(text.cast("binary"), start + 1, stop - start).cast("string")


def byte_line(text: Column, offset: Column) -> Column:
    """1-based line of a byte offset."""
    head = F.substring(text.cast("binary"), F.lit(1), offset).cast("string")
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def frontmatter(text: Column) -> Column:
    """(header, body) of a note; the header is empty if it does not start with one."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    has = F.regexp_like(text, F.lit(pattern))
    return F.struct(
        F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(F.lit("")).alias("header"),
        F.when(has, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0."""
    zero = F.lit(0.0)
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + d(x) * d(x)))
    under = norm(a) * norm(b)
    return F.when(under > 0, dot / under).otherwise(zero)


def l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def file_tier(path: Column) -> Column:
    """Whether a file without importers may still be used by shape: request, schema and type files."""
    near = F.regexp_extract(F.lower(path), "([^/]*/)?[^/]*$", 0)
    shaped = near.rlike("request|schema|types|contract|interface|model|dto")
    return F.when(extension(path).isin("ts", "tsx") & shaped, "needs_structural_evidence").otherwise("high")


def markup_penalty(path: Column, query: Column) -> Column:
    """Configuration and markup count .55, unless the query is about it."""
    asked = F.lower(query).rlike("config|yaml|yml|json|toml|markdown|readme|settings")
    return F.when(extension(path).isin(*STRUCTURED_TYPES) & ~asked, 0.55).otherwise(1.0)
