"""Where calls go: a cascade of equi-joins over distinct call sites, and what is asked of the result.

Inputs are tables: calls (caller_file, caller_path, callee_name, qualifier), symbols (name, kind, file_path,
name_path), imports (src, dst: files), bindings (file, local, imported, target, external) of module clauses.
``imported`` is the name in the other module, ``*`` all of it, null the same name; ``target`` its file.  What a
module hands on as a whole has ``*`` as local name too.

No stage pairs calls with all definitions of a name.  A file and a name are a key, names that a file sees
through its imports are reduced to one target each before they meet the calls, unique names are counted, and
the nearest definition is found by the directories that it shares, one row a directory.  Where several files
would do, the least path is taken.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.modules import JS_EXPORT_FROM, JS_IMPORT_FROM
from quarry.storage import written

# Strategies with their confidences, and languages whose calls are resolved.
CONFIDENCE = {
    "owner_qualified": 0.98, "same_file": 0.90, "import_map": 0.95, "import_reexport_map": 0.93, "import_suffix": 0.70,
    "unique_name": 0.65, "path_proximity": 0.50, "unresolved": 0.25,
}
LANGUAGES = ("py", "js", "jsx", "ts", "tsx", "go", "java", "kt", "rs")
BINDING_LANGUAGES = ("js", "jsx", "ts", "tsx")
BINDINGS = "file string, local string, imported string, target string, external boolean"


def language(path: Column) -> Column:
    ext = T.extension(path)
    return F.when(ext.isin(*LANGUAGES), ext)


def _owner_key(raw: Column) -> Column:
    last = F.trim(F.element_at(F.split(raw, "::"), -1))
    key = F.trim(F.split(last, "<")[0])
    return F.when(key != "", key)


def _before_last(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def owner(file: Column, qualifier: Column, caller_path: Column) -> Column:
    """The type that a Rust call names before the callee; ``Self`` is the caller's own."""
    key = _owner_key(qualifier)
    named = F.when(key == "Self", _owner_key(_before_last(caller_path))).when(key.rlike(r"^\p{Lu}"), key)
    return F.when(file.endswith(".rs"), named)


def _prefixes(path: Column) -> Column:
    """(depth, directory) of each directory above a file."""
    parts = F.split(path, "/")
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")),
    )


def _tails(path: str) -> Column:
    """All ends of a path that start at a component."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def _offers(imports: DataFrame, defs: DataFrame) -> DataFrame:
    """(dst, name, far, file): where an import has a name from, its own file or else the least that it ends like, or that ends like it.

    Imports that are spelled alike are one: each has one file a name, before any importer meets it.
    """
    targets = imports.select("dst").distinct()
    files = defs.select("file").distinct()
    longer = files.select("file", F.explode(_tails("file")).alias("dst")).join(targets, "dst")
    shorter = targets.select("dst", F.explode(_tails("dst")).alias("file")).join(files, "file")
    pairs = longer.select("dst", "file").union(shorter.select("dst", "file"))
    best = F.min(F.struct((F.col("dst") != F.col("file")).alias("far"), "file")).alias("m")
    return pairs.join(defs, "file").groupBy("dst", "name").agg(best).select("dst", "name", "m.far", "m.file")


#: Imports, and names with their files, that a task holds; and pairs of them that it sorts at a time.
IN_BLOCK, AT_ONCE = 100_000, 1 << 21


def _least():
    """(src, name, far, file): the least of what the imports (src, dst) of a file offer for a name, in a task."""

    def run(imports: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        dsts, of = np.unique(offers["dst"].to_numpy(object), return_inverse=True)
        at = pd.Index(dsts).get_indexer(imports["dst"])
        src, srcs = pd.factorize(imports["src"].to_numpy(object)[at >= 0])
        order = np.argsort(src, kind="stable")
        src, at = src[order], at[at >= 0][order]
        name, names = pd.factorize(offers["name"].to_numpy(object))
        files, rank = np.unique(offers["file"].to_numpy(object), return_inverse=True)
        rank = rank + offers["far"].to_numpy(bool) * len(files)
        by = np.argsort(of, kind="stable")
        name, rank, starts = name[by], rank[by], np.searchsorted(of[by], np.arange(len(dsts) + 1))
        n = starts[at + 1] - starts[at]
        ends, width, out = np.cumsum(n), 2 * len(files), []

        def first(both: np.ndarray) -> np.ndarray:
            both = np.sort(both)
            return both[np.r_[True, both[1:] // width != both[:-1] // width]] if len(both) else both

        k = 0
        while k < len(at):  # one number a pair: file, name and rank of what is offered
            m = max(k + 1, int(np.searchsorted(ends, ends[k] - n[k] + AT_ONCE, "right")))
            here = n[k:m]
            row = np.repeat(starts[at[k:m]] - (np.cumsum(here) - here), here) + np.arange(here.sum())
            out.append(first((np.repeat(src[k:m], here).astype(np.int64) * len(names) + name[row]) * width + rank[row]))
            k = m
        found = first(np.concatenate(out)) if out else np.zeros(0, np.int64)
        key, rank = found // max(width, 1), found % max(width, 1)
        get = lambda a, i: a[i] if len(i) else np.zeros(0, object)
        return pd.DataFrame({
            "src": get(srcs, key // max(len(names), 1)), "name": get(names, key % max(len(names), 1)),
            "far": rank >= len(files), "file": get(files, rank % max(len(files), 1)),
        })

    return run


def _sees(imports: DataFrame, offers: DataFrame) -> DataFrame:
    """(caller_file, callee_name, seen: (far, file)): the least file that an import of a file offers for a name.

    A file and each name that it could see are far more than both tables, so that they meet and are reduced within
    a task: importers are cut into blocks, each gets the offers of what it imports once, cut by names.
    """
    blocks = max(1, math.ceil(imports.count() / IN_BLOCK))
    links = imports.withColumn("i", F.pmod(F.xxhash64("src"), F.lit(blocks)))
    asked = links.select("i", "dst").distinct()
    met = asked.join(offers.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "dst").groupBy("i").agg(F.sum("n").alias("n"))
    parts = max(1, math.ceil((met.agg(F.max("n")).first()[0] or 0) / IN_BLOCK))
    left = links.select(F.col("i").alias("k"), "src", "dst", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("l"))
    right = offers.withColumn("j", F.pmod(F.xxhash64("name"), F.lit(parts))).join(asked, "dst")
    met = left.groupBy("k", "l").cogroup(right.groupBy("i", "j")).applyInPandas(_least(), "src string, name string, far boolean, file string")
    return met.select(F.col("src").alias("caller_file"), F.col("name").alias("callee_name"), F.struct("far", "file").alias("seen"))


def _exports(bindings: DataFrame, defs: DataFrame) -> DataFrame:
    """(file, name, own, again): whether a module defines a name, and else where it has from what it hands on.

    A name that a module binds is handed on from there; all others come from what it hands on as a whole.
    """
    there = defs.select(F.col("file").alias("target"), F.col("name").alias("to"))
    named = bindings.where("target IS NOT NULL").withColumn("to", F.when(F.col("imported") == "*", F.col("local")).otherwise(F.coalesce("imported", "local")))
    one = named.where("local <> '*'").join(there, ["target", "to"], "left_semi").select("file", F.col("local").alias("name"), "target", "to")
    taken = bindings.select("file", F.col("local").alias("name"))
    rest = named.where("local = '*'").select("file", "target").join(there, "target").select("file", F.col("to").alias("name"), "target", "to")
    rest = rest.join(taken, ["file", "name"], "left_anti")
    again = F.struct(F.col("target").alias("file"), F.col("to").alias("name"))
    rows = one.unionByName(rest).select("file", "name", F.lit(False).alias("own"), again.alias("again"))
    mine = defs.select("file", "name", F.lit(True).alias("own"), F.lit(None).cast("struct<file:string,name:string>").alias("again"))
    return rows.unionByName(mine).groupBy("file", "name").agg(F.max("own").alias("own"), F.min("again").alias("again"))


def _bound(bindings: DataFrame, exports: DataFrame) -> DataFrame:
    """(file, local, imported, target, inner, goes): bindings with the module that a bound name stands for in its
    module, and with where a call of the local name goes: (own: whether the module defines it, file, name)."""
    inner = bindings.where("imported = '*'").select(F.col("file").alias("target"), F.col("local").alias("imported"), F.col("target").alias("inner"))
    out = exports.select(F.col("file").alias("target"), F.col("name").alias("to"), "own", "again")
    rows = bindings.join(inner, ["target", "imported"], "left").withColumn("to", F.coalesce("imported", "local")).join(out, ["target", "to"], "left")
    here = F.struct(F.lit(True).alias("own"), F.col("target").alias("file"), F.col("to").alias("name"))
    there = F.struct(F.lit(False).alias("own"), F.col("again.file").alias("file"), F.col("again.name").alias("name"))
    goes = F.when(F.col("own"), here).when(F.col("again").isNotNull(), there)
    return rows.select("file", "local", "imported", "target", "inner", goes.alias("goes"))


def drop_external(calls: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls but those of names that come from outside the project, at first or second hand."""
    own = bindings.select("file", "local", F.coalesce("external", F.lit(False)).alias("external"))
    outer = own.where("external").select(F.col("file").alias("target"), F.col("local").alias("imported")).distinct()
    handed = bindings.join(outer, ["target", "imported"], "left_semi").select("file", "local")
    # clauses are few, and joined among themselves: calls without any have no key that would bring them together
    gone = own.where("external").select("file", "local").union(handed).toDF("caller_file", "_used").distinct()
    return calls.withColumn("_used", F.coalesce("qualifier", "callee_name")).join(gone, ["caller_file", "_used"], "left_anti").select(*calls.columns)


def resolve(calls: DataFrame, symbols: DataFrame, imports: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """``calls`` with resolved_file, strategy, confidence, canonical_name and declaration.

    Stages, the first that fits: the type that a call names, the own file, a module clause and what it hands
    on, any imported file, files that an import ends like, the only definition in the caller's language, the
    one that shares most directories.  For languages with module clauses a unique name elsewhere only counts as
    near.  Calls of the same site go the same way, so that each is resolved once.
    """
    if bindings is None:
        bindings = calls.sparkSession.createDataFrame([], BINDINGS)
    bindings = bindings.groupBy("file", "local").agg(F.min(F.struct("imported", "target", "external")).alias("m")).select("file", "local", "m.*")
    keys = ["caller_file", "callee_name"]
    calls = calls.withColumn("owner", owner(F.col("caller_file"), F.col("qualifier"), F.col("caller_path")))
    # what several stages read is a table of its own, which also keeps the plan of each small
    asked = written(calls.select(*keys).distinct(), "call-keys")
    called = asked.select(F.col("callee_name").alias("name")).distinct()
    defs = written(symbols.select("name", F.col("file_path").alias("file")).distinct(), "call-definitions")
    bindings = written(bindings, "call-bindings")
    imports = written(imports.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "call-imports")

    methods = symbols.where((F.col("kind") == "method") & F.col("file_path").endswith(".rs") & F.contains("name_path", F.lit("/")))
    declared = (
        methods.groupBy(F.col("name").alias("callee_name"), _owner_key(_before_last(F.col("name_path"))).alias("owner"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file_path", "name_path")).alias("owned"))
        .where("n = 1")
        .drop("n")
    )
    typed = calls.where("owner IS NOT NULL").select(*keys, "owner").distinct().join(declared, ["callee_name", "owner"])
    typed = typed.groupBy(*keys).agg(F.collect_list(F.struct("owner", "owned")).alias("types"))

    exports = written(_exports(bindings, defs), "call-exports")
    bound = written(_bound(bindings, exports), "call-bound")
    space = bound.select(
        F.col("file").alias("caller_file"), F.col("local").alias("qualifier"), F.col("imported").alias("s_name"), F.col("target").alias("s_file"), F.col("inner").alias("i_file")
    )
    spaces = calls.where("owner IS NULL AND qualifier IS NOT NULL").select(*keys, "qualifier").distinct().join(space, ["caller_file", "qualifier"])
    for side in "si":
        seen = exports.select(F.col("file").alias(f"{side}_file"), F.col("name").alias("callee_name"), F.col("own").alias(f"{side}_there"), F.col("again").alias(f"{side}_again"))
        spaces = spaces.join(seen, [f"{side}_file", "callee_name"], "left").withColumn(f"{side}_there", F.coalesce(f"{side}_there", F.lit(False)))
    one = F.struct("qualifier", "s_name", *[f"{side}_{x}" for side in "si" for x in ("file", "there", "again")])
    spaces = spaces.groupBy(*keys).agg(F.collect_list(one).alias("spaces"))

    rows = asked.withColumn("lang", language(F.col("caller_file"))).withColumn("dir", _before_last(F.col("caller_file")))
    spoken = symbols.select(F.col("name").alias("callee_name"), "file_path", language(F.col("file_path")).alias("lang")).where("lang IS NOT NULL")
    only = spoken.groupBy("callee_name", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("only")).where("n = 1").drop("n")
    by_dir = (
        spoken.distinct().select("callee_name", "lang", "file_path", F.explode(_prefixes(F.col("file_path"))).alias("p"))
        .groupBy("callee_name", "lang", F.col("p.dir").alias("up"))
        .agg(F.min("file_path").alias("file"))
    )
    near = (
        rows.select("callee_name", "lang", "dir").where("lang IS NOT NULL AND dir <> ''").distinct()
        .select("*", F.explode(_prefixes(F.concat("dir", F.lit("/")))).alias("p"))
        .select("callee_name", "lang", "dir", "p.depth", F.col("p.dir").alias("up"))
        .join(by_dir, ["callee_name", "lang", "up"])
        .groupBy("callee_name", "lang", "dir")
        .agg(F.max_by("file", "depth").alias("near"))
    )
    rows = rows.join(only, ["callee_name", "lang"], "left").join(near, ["callee_name", "lang", "dir"], "left")
    here = defs.select(F.col("file").alias("caller_file"), F.col("name").alias("callee_name"), F.lit(True).alias("local"))
    rows = rows.join(here, keys, "left").withColumn("local", F.coalesce("local", F.lit(False)))
    direct = bound.select(F.col("file").alias("caller_file"), F.col("local").alias("callee_name"), F.col("goes").alias("bound"))
    offers = written(_offers(imports, defs.join(called, "name", "left_semi")), "call-offers")
    rows = rows.join(direct, keys, "left").join(_sees(imports, offers), keys, "left").join(typed, keys, "left").join(spaces, keys, "left")

    def to(when: Column, strategy: str, file, name="callee_name", declaration=None) -> tuple[Column, Column]:
        f, n, d = (F.col(x) if isinstance(x, str) else x if x is not None else F.lit(None).cast("string") for x in (file, name, declaration))
        goes = F.struct(
            f.alias("resolved_file"), F.lit(strategy).alias("strategy"), F.lit(CONFIDENCE[strategy]).alias("confidence"),
            n.alias("canonical_name"), d.alias("declaration"),
        )
        return when, goes

    def pick(stages: list[tuple[Column, Column]], last: Column) -> Column:
        return reduce(lambda acc, s: acc.when(*s), stages, F).otherwise(last)

    none = F.lit(None).cast("string")
    has = F.col
    # what a file and a name decide, whatever stands before the name
    rest = pick([
        to(F.coalesce("bound.own", F.lit(False)), "import_map", F.col("bound.file"), F.col("bound.name")),
        to(has("bound").isNotNull(), "import_reexport_map", F.col("bound.file"), F.col("bound.name")),
        to(~has("seen.far"), "import_map", "seen.file"),
        to(has("seen").isNotNull(), "import_suffix", "seen.file"),
        to(has("only").isNotNull() & has("lang").isin(*BINDING_LANGUAGES) & (has("only") != has("caller_file")), "path_proximity", "only"),
        to(has("only").isNotNull(), "unique_name", "only"),
        to(has("near").isNotNull(), "path_proximity", "near"),
    ], to(F.lit(True), "unresolved", none, none)[1])
    rows = rows.select(*[F.col(c).alias(f"_{c}") for c in keys], "local", "types", "spaces", rest.alias("rest"))

    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    of = lambda column, key: F.get(F.filter(column, lambda x: x[key] == F.col(key)), F.lit(0))
    both = calls.join(rows, same, "left").withColumn("owned", of("types", "owner")["owned"])
    both = both.withColumn("space", F.when(F.col("owner").isNull(), of("spaces", "qualifier")))
    namespace = F.coalesce(F.col("space.s_name") == "*", F.lit(False))
    picked = pick([
        to(has("owned").isNotNull(), "owner_qualified", F.col("owned.file_path"), "callee_name", F.col("owned.name_path")),
        to(has("owner").isNotNull(), "unresolved", none, none, F.concat_ws("/", "owner", "callee_name")),
        to(has("local") & ~namespace, "same_file", "caller_file"),
        to(namespace & has("space.s_there"), "import_map", "space.s_file"),
        to(namespace & has("space.s_again").isNotNull(), "import_reexport_map", F.col("space.s_again.file"), F.col("space.s_again.name")),
        to(~namespace & has("space.i_there"), "import_reexport_map", "space.i_file"),
        to(~namespace & has("space.i_again").isNotNull(), "import_reexport_map", F.col("space.i_again.file"), F.col("space.i_again.name")),
    ], F.col("rest"))
    return both.select(*[c for c in calls.columns if c != "owner"], picked.alias("goes")).select(*[c for c in calls.columns if c != "owner"], "goes.*")


def naming(calls: DataFrame, bindings: DataFrame, name: str) -> DataFrame:
    """The calls that may mean a name: those that say it, and those of a name that a clause, at first or second hand, has for it."""
    b = bindings.select("local", F.when(F.col("imported") == "*", F.col("local")).otherwise(F.coalesce("imported", "local")).alias("to")).distinct()
    first = b.where(F.col("to") == name).select("local").distinct()
    second = b.join(first.withColumnRenamed("local", "to"), "to", "left_semi").select("local")
    said = calls.sparkSession.createDataFrame([(name,)], "callee_name string").union(first).union(second).distinct()
    return calls.join(said, "callee_name", "left_semi")


def callers(resolved: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """(caller_file, caller_name, confidence): who calls a name; with a file, only calls that resolve to it by that name."""
    hit = F.col("canonical_name") == name
    hit = hit & (F.col("resolved_file") == file) if file else hit | (F.col("callee_name") == name)
    return resolved.where(hit).groupBy("caller_file", "caller_name").agg(F.max("confidence").alias("confidence"))


def callees(resolved: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """(callee_name, resolved_file, confidence): what a function calls."""
    rows = resolved.where(F.col("caller_name") == name)
    rows = rows.where(F.col("caller_file") == file) if file else rows
    return rows.groupBy(F.coalesce("canonical_name", "callee_name").alias("callee_name"), "resolved_file").agg(
        F.max("confidence").alias("confidence")
    )


def module_clauses(files: DataFrame) -> DataFrame:
    """(file, local, imported, module): what each import-from and export-from clause binds, in files (relative_path, content)."""
    rows = files.where(T.extension(F.col("relative_path")).isin(*BINDING_LANGUAGES))

    def found(word: str) -> DataFrame:
        p = F.lit(JS_IMPORT_FROM if word == "import" else JS_EXPORT_FROM)
        both = F.arrays_zip(F.regexp_extract_all("content", p, 1).alias("clause"), F.regexp_extract_all("content", p, 2).alias("module"))
        got = rows.select(F.col("relative_path").alias("file"), F.explode(both).alias("x")).select("file", "x.*")
        return got.withColumn("clause", F.trim(F.regexp_replace("clause", r"^\s*type\s+", ""))).withColumn("export", F.lit(word == "export"))

    got = found("import").unionAll(found("export"))
    named = F.regexp_extract("clause", r"(?s)\{(.*)\}", 1)
    outside = F.regexp_replace("clause", r"(?s)\{.*\}", "")
    item = lambda local, imported: F.struct(local.alias("local"), imported.alias("imported"))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ ?type ", ""))
    inside = F.transform(
        F.filter(F.transform(F.split(named, ","), clean), lambda x: x != ""),
        lambda x: item(F.element_at(F.split(x, " as "), -1), F.split(x, " as ")[0]),
    )
    default = F.transform(
        F.filter(F.transform(F.split(outside, ","), clean), lambda x: x != ""),
        lambda x: F.when(x == "*", item(F.lit("*"), F.lit("*")))
        .when(x.startswith("* as "), item(F.regexp_replace(x, r"^\* as ", ""), F.lit("*")))
        .otherwise(item(x, F.lit(None).cast("string"))),
    )
    default = F.when(F.col("export"), F.filter(default, lambda x: x["imported"].isNotNull())).otherwise(default)
    return got.select("file", "module", F.explode(F.concat(inside, default)).alias("b")).select(
        "file", "b.local", "b.imported", "module"
    ).distinct()


def bind(clauses: DataFrame, resolved: DataFrame) -> DataFrame:
    """Bindings from module clauses and resolved imports (relative_path, raw_import, target): foreign are bare names without a file."""
    target = resolved.select(F.col("relative_path").alias("file"), F.col("raw_import").alias("module"), "target").distinct()
    foreign = F.col("target").isNull() & ~F.col("module").rlike("^[./]")
    # a merge, as in ``modules.resolve``
    return clauses.hint("merge").join(target, ["file", "module"], "left").select("file", "local", "imported", "target", foreign.alias("external"))
