"""What files import, and which files that means: patterns per language, then candidate paths in order.

Both are Column expressions over one row; a resolved import is the first of its candidates that is a file,
found by one equi-join of all candidates with the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

# What each language's imports look like.
PY_IMPORT = r"(?m)^\s*import\s+([A-Za-z0-9_.,\s]+)"
PY_FROM = r"(?m)^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+"
JS_IMPORT_FROM = r"""(?m)\bimport\s+([^;]+?)\s+from\s+["']([^"']+)["']"""
JS_IMPORT_ONLY = r"""(?m)\bimport\s+["']([^"']+)["']"""
JS_REQUIRE = r"""require\(\s*["']([^"']+)["']\s*\)"""
JS_DYNAMIC = r"""import\(\s*["']([^"']+)["']\s*\)"""
JS_EXPORT_FROM = r"""(?m)\bexport\s+([^;]+?)\s+from\s+["']([^"']+)["']"""
GO_SINGLE = r'(?m)^\s*import\s+"([^"]+)"'
GO_BLOCK = r"(?s)\bimport\s*\(([^)]*)\)"
GO_QUOTED = r'"([^"]+)"'
JAVA_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)\s*;"
KT_IMPORT = r"(?m)^\s*import\s+([A-Za-z0-9_.]+)(?:\s+as\s+[A-Za-z0-9_]+)?"
RS_USE = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([A-Za-z0-9_]+(?:::[A-Za-z0-9_]+)*)(?:::\{([^}]+)\})?"
RS_MOD = r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z0-9_]+)\s*;"
RB_REQUIRE = r"""(?m)^\s*(?:require|require_relative|load)\s+["']([^"']+)["']"""
C_INCLUDE = r'(?m)^\s*#\s*include\s+[<"]([^>"]+)[>"]'
PHP_USE = r"(?m)^\s*use\s+([A-Za-z0-9_\\]+)\s*;"
PHP_REQUIRE = r"""(?m)^\s*(?:require|require_once|include|include_once)\s+["']([^"']+)["']\s*;"""
CS_USING = r"(?m)^\s*using\s+(?:static\s+)?([A-Za-z0-9_.]+)\s*;"
DART_IMPORT = r"""(?m)^\s*import\s+["']([^"']+)["']"""
DART_EXPORT = r"""(?m)^\s*export\s+["']([^"']+)["']"""
SCALA_IMPORT = r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)"
SWIFT_IMPORT = r"(?m)^\s*import\s+(?:class\s+|struct\s+|enum\s+|protocol\s+|func\s+)?([A-Za-z0-9_\.]+)"
CSS_IMPORT = r"""(?m)@import\s+(?:url\()?["']([^"']+)["']\)?"""
HTML_LINK = r'href="([^"]+)"'
EXTENSIONS = {
    "py": ("py",), "js": ("js", "jsx", "ts", "tsx", "mjs", "cjs"), "go": ("go",), "java": ("java",), "kt": ("kt", "kts"), "rs": ("rs",),
    "rb": ("rb",), "c": ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"), "php": ("php",), "cs": ("cs",), "dart": ("dart",),
    "scala": ("scala", "sc"), "swift": ("swift",), "css": ("css", "scss", "less"), "html": ("html",),
}
JS_EXTENSIONS = ("js", "jsx", "ts", "tsx", "mjs", "cjs")
PYTHON_ROOTS = ("src", "lib", "app")


def _all(pattern: str, group: int = 1, text: Column | None = None) -> Column:
    return F.regexp_extract_all(F.col("content") if text is None else text, F.lit(pattern), group)


def _none() -> Column:
    return F.array().cast("array<string>")


def _python() -> Column:
    modules = F.flatten(F.transform(_all(PY_IMPORT), lambda m: F.split(m, ",")))
    first = F.transform(modules, lambda m: F.regexp_extract(m, r"^\s*(\S+)", 1))
    return F.concat(F.filter(first, lambda m: m != ""), _all(PY_FROM))


def _rust() -> Column:
    used = F.arrays_zip(_all(RS_USE, 1).alias("base"), _all(RS_USE, 2).alias("items"))

    def spread(u: Column) -> Column:
        items = F.filter(F.transform(F.split(u["items"], ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
        return F.when(u["items"] == "", F.array(u["base"])).otherwise(F.transform(items, lambda x: F.concat(u["base"], F.lit("::"), x)))

    return F.concat(_all(RS_MOD), F.flatten(F.transform(used, spread)))


def _found() -> dict[str, Column]:
    block = F.flatten(F.transform(_all(GO_BLOCK), lambda b: _all(GO_QUOTED, 1, b)))
    return {
        "py": _python(),
        "js": F.concat(_all(JS_IMPORT_FROM, 2), _all(JS_IMPORT_ONLY), _all(JS_REQUIRE), _all(JS_DYNAMIC), _all(JS_EXPORT_FROM, 2)),
        "go": F.concat(_all(GO_SINGLE), block),
        "java": _all(JAVA_IMPORT),
        "kt": _all(KT_IMPORT),
        "rs": _rust(),
        "rb": _all(RB_REQUIRE),
        "c": _all(C_INCLUDE),
        "php": F.concat(_all(PHP_USE), _all(PHP_REQUIRE)),
        "cs": _all(CS_USING),
        "dart": F.filter(F.concat(_all(DART_IMPORT), _all(DART_EXPORT)), lambda x: ~x.startswith("dart:")),
        "scala": _all(SCALA_IMPORT),
        "swift": _all(SWIFT_IMPORT),
        "css": _all(CSS_IMPORT),
        "html": _all(HTML_LINK),
    }


def language(path: Column) -> Column:
    ext = T.extension(path)
    return reduce(lambda acc, kv: acc.when(ext.isin(*kv[1]), kv[0]), EXTENSIONS.items(), F)


#: Where the tests of a Rust file begin.
TEST_SECTION = r"(?m)^\s*#\[cfg\((?:all\()?test\b.*\]"


def extract(files: DataFrame, tests: bool = True) -> DataFrame:
    """(id, relative_path, raw_import): what the text of each file imports, once each, in all languages at once.

    Without tests, a Rust file counts up to its first test section: such imports make no cycles of the program.
    """
    lang = language(F.col("relative_path"))
    if not tests:
        files = files.withColumn("content", F.when(lang == "rs", F.split("content", TEST_SECTION, 2)[0]).otherwise(F.col("content")))
    found = reduce(lambda acc, kv: acc.when(lang == kv[0], kv[1]), _found().items(), F).otherwise(_none())
    return files.select("id", "relative_path", F.explode(F.array_distinct(found)).alias("raw_import"))


def normal(path: Column) -> Column:
    """A path without empty parts, . and ..; what leaves the root is cut off there.  Most paths have none, and are not taken apart."""
    parts = F.aggregate(
        F.split(path, "/"),
        _none(),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(path.rlike(r"(?:^|/)\.{0,2}(?:/|$)"), F.array_join(parts, "/")).otherwise(path)


def _paths(*parts) -> Column:
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _heads(parts: Column) -> Column:
    """A path's parts joined: all of them, then without the last, and so on to the first."""
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, 1, n - i), "/"))


def _each(items: Column, *shapes) -> Column:
    return F.flatten(F.transform(items, lambda x: F.array(*[s(x) for s in shapes])))


def candidates(module: Column, file: Column, go_module: str | None = None) -> dict[str, Column]:
    """Per language the keys of the files that an import may mean, in order; ``_keys`` says what keys there are."""
    here = F.regexp_replace(F.regexp_extract(file, "^(.*/)", 1), "/$", "")
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    base = _paths(here, F.repeat(F.lit("../"), dots - 1))
    init = lambda p: _paths(p, "__init__.py")
    with_ext = lambda e: lambda p: F.concat(p, F.lit("." + e))
    python = (
        F.when((dots > 0) & (rest == ""), F.array(init(base)))
        .when(dots > 0, _each(F.array(_paths(base, rest)), with_ext("py"), init))
        .otherwise(_each(F.array(_paths(here, slashed), slashed, *[_paths(r, slashed) for r in PYTHON_ROOTS]), with_ext("py"), init))
    )

    start = (
        F.when(module.startswith("@/"), F.array(*[_paths(r, F.substring(module, F.lit(3), F.length(module))) for r in ("src", "app", "lib")]))
        .when(module.startswith("~/"), F.array(_paths("src", F.substring(module, F.lit(3), F.length(module)))))
        .when(module.startswith("/"), F.array(F.regexp_replace(module, "^/+", "")))
        .when(module.startswith("."), F.array(_paths(here, module)))
        .otherwise(_none())
    )

    def js(p: Column) -> Column:
        ext = F.regexp_extract(p, r"[^/.]\.([^./]+)$", 1)
        bare = F.when(ext != "", F.regexp_replace(p, r"\.[^./]*$", "")).otherwise(p)
        more = [F.concat(bare, F.lit("." + e)) for e in JS_EXTENSIONS] + [F.concat(bare, F.lit("/index." + e)) for e in JS_EXTENSIONS]
        return F.when(ext.isin("", "js", "jsx", "mjs", "cjs"), F.array(p, *more)).otherwise(F.array(p))

    last = F.element_at(F.split(module, "/"), -1)
    whole = F.array(module, last)
    if go_module:
        inside = F.regexp_replace(F.substring(module, F.lit(len(go_module) + 1), F.length(module)), "^/+", "")
        whole = F.when(module.startswith(go_module), F.array(inside)).otherwise(whole)
    go = F.when(
        F.contains(module, F.lit(".")), _each(whole, lambda p: F.concat(F.lit("go:"), p), with_ext("go"))
    ).otherwise(_none())

    jvm = F.flatten(
        F.array(*[F.array(*[F.concat(F.lit(r), slashed, F.lit("." + e)) for r in ("", "src/main/java/", "src/main/kotlin/", "src/")]) for e in ("java", "kt")])
    )

    relative = module.startswith("super::") | module.startswith("self::")
    stripped = F.regexp_replace(F.regexp_replace(F.regexp_replace(module, "^(crate::)+", ""), "^(super::)+", ""), "^(self::)+", "")
    parts = F.split(stripped, "::")
    mod = lambda p: _paths(p, "mod.rs")
    beside = lambda f: lambda x: f(_paths(here, x))
    rs = with_ext("rs")
    crate = lambda f: lambda x: F.concat(F.lit("crate:"), parts[0], F.lit("/"), f(x))
    any_ = lambda f: lambda x: F.concat(F.lit("any:"), f(x))
    src = lambda f: lambda x: f(_paths("src", x))
    own = F.when(F.size(parts) > 1, _each(_heads(F.slice(parts, 2, F.size(parts))), crate(rs), crate(mod))).otherwise(_none())
    rust = F.when(relative, _each(_heads(parts), beside(rs), beside(mod))).otherwise(
        F.concat(own, _each(_heads(parts), beside(rs), beside(mod), src(rs), src(mod), any_(rs), any_(mod)))
    )

    folders = lambda *names: F.array(here, *[F.lit(n) for n in names])
    ruby_in = F.when(module.startswith("."), F.array(here)).otherwise(F.array(F.lit(""), F.lit("lib"), F.lit("app")))
    suffixed = F.when(last.rlike(r"[^.]\.[^.]+$"), module).otherwise(F.concat(module, F.lit(".rb")))
    spaced = F.replace(module, F.lit("\\"), F.lit("/"))
    php = F.when(spaced.endswith(".php"), spaced).otherwise(F.concat(spaced, F.lit(".php")))
    packaged = F.regexp_extract(module, "^package:[^/]*/(.*)$", 1)
    return {
        "py": python,
        "js": F.flatten(F.transform(start, js)),
        "go": go,
        "java": jvm,
        "kt": jvm,
        "rs": rust,
        "rb": _each(ruby_in, lambda d: _paths(d, suffixed), lambda d: _paths(d, module)),
        "c": _each(folders("", "include", "inc", "src"), lambda d: _paths(d, module)),
        "php": _each(folders("", "src", "app", "lib"), lambda d: _paths(d, php), lambda d: _paths(d, spaced)),
        "cs": F.array(F.concat(slashed, F.lit(".cs")), F.concat(F.element_at(F.split(module, r"\."), -1), F.lit(".cs"))),
        "dart": F.when(module.startswith("package:"), F.when(packaged != "", F.array(_paths("lib", packaged))).otherwise(_none())).otherwise(
            F.array(_paths(here, module))
        ),
    }


def _keys(files: DataFrame) -> DataFrame:
    """(key, target): files by path, Go folders by their first file, Rust files by crate and by path within any."""
    paths = files.select(F.col("relative_path").alias("target")).distinct()
    p = F.col("target")
    folders = paths.where(p.endswith(".go")).select(F.concat(F.lit("go:"), F.regexp_replace(F.regexp_extract(p, "^(.*/)", 1), "/$", "")).alias("key"), p)
    rust = paths.select(F.regexp_extract(p, "^crates/([^/]+)/src/(.+)$", 1).alias("crate"), F.regexp_extract(p, "^crates/([^/]+)/src/(.+)$", 2).alias("rest"), p)
    rust = rust.where("rest <> ''")
    manifest = paths.select(F.regexp_extract(p, "^crates/([^/]+)/Cargo.toml$", 1).alias("crate")).where("crate <> ''")
    named = rust.hint("merge").join(manifest, "crate", "left_semi").select(F.concat(F.lit("crate:"), F.replace("crate", F.lit("-"), F.lit("_")), F.lit("/"), "rest").alias("key"), "target")
    anywhere = rust.select(F.concat(F.lit("any:"), "rest").alias("key"), "target")
    several = reduce(DataFrame.unionAll, [folders, named, anywhere]).groupBy("key").agg(F.min("target").alias("target"))
    return paths.select(p.alias("key"), "target").unionAll(several)


def resolve(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """``imports`` (id, relative_path, raw_import) with target: the first candidate that is a file, or null.

    The joins are merges: texts may be many times what they are made from, so that the planner takes them for small,
    and candidates, up to 40 an import, would be sent whole.
    """
    lang = language(F.col("relative_path"))
    lists = candidates(F.col("raw_import"), F.col("relative_path"), go_module)
    found = reduce(lambda acc, kv: acc.when(lang == kv[0], kv[1]), lists.items(), F).otherwise(_none())

    def clean(key: Column) -> Column:
        tag = F.regexp_extract(key, "^(go|crate|any):", 0)
        return F.concat(tag, normal(F.regexp_replace(key, "^(go|crate|any):", "")))

    asked = imports.select("id", "relative_path", "raw_import").distinct()
    tried = asked.select("relative_path", "raw_import", F.posexplode(found).alias("at", "key")).withColumn("key", clean(F.col("key")))
    best = tried.hint("merge").join(_keys(files), "key").groupBy("relative_path", "raw_import").agg(F.min_by("target", "at").alias("target"))
    return asked.hint("merge").join(best, ["relative_path", "raw_import"], "left").select("id", "relative_path", "raw_import", "target")


def import_edges(files: DataFrame, go_module: str | None = None, tests: bool = True) -> DataFrame:
    """(src, dst): files and the files of the project that they import."""
    rows = resolve(extract(files, tests), files, go_module).where("target IS NOT NULL")
    return rows.select(F.col("relative_path").alias("src"), F.col("target").alias("dst")).distinct()
