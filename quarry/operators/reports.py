"""Compositions: what a user asks in one go, put together from the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import graph, lookup, rank, vector
from quarry.operators.sizes import batch, small


def onboard(symbols: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(section, item, value): directories by symbols, the most important nodes, the cycles by size."""
    dirs = lookup.dir_stats(symbols).orderBy(F.col("symbols").desc(), "dir").limit(top)
    pr = graph.pagerank(edges).orderBy(F.round("score", 9).desc(), "node").limit(top)
    cyc = graph.cycles(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(top)
    row = lambda df, s, i, v: df.select(F.lit(s).alias("section"), F.col(i).cast("string").alias("item"), v.alias("value"))
    return (
        row(dirs, "directory", "dir", F.col("symbols").cast("string"))
        .unionAll(row(pr, "important", "node", F.format_string("%.4f", "score")))
        .unionAll(row(cyc, "cycle", "component", F.col("n").cast("string")))
    )


def candidate_pool(symbols: DataFrame, importers: DataFrame, queries: DataFrame, per_token: int = 10, files: int = 10) -> DataFrame:
    """(query_id, id, lane): symbols of the files whose paths hit most tokens, of name matches, and of importers.

    First lane wins per symbol. Lanes are cut per query before they meet.
    """
    toks = queries.select("query_id", F.explode(T.query_tokens(F.col("query"))).alias("token"))
    paths = symbols.select("file_path").distinct()
    hit = paths.join(batch(toks), F.contains(F.lower("file_path"), F.col("token")))
    scored = hit.groupBy("query_id", "file_path").agg(F.count(F.lit(1)).alias("hits"))
    top = rank.top_k(scored, files, "hits", "file_path")
    few = top.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where("n <= 5 AND rank <= 3")
    near = few.join(importers.select(F.col("dst").alias("file_path"), F.col("src").alias("user")), "file_path").select("query_id", F.col("user").alias("file_path"))
    match = symbols.join(batch(toks), F.contains(F.lower("name"), F.col("token"))).select("query_id", "token", "id", F.length("name").alias("len"))
    by = Window.partitionBy("query_id", "token").orderBy("len", "id")
    match = match.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_token)
    lanes = [
        top.join(symbols, "file_path").select("query_id", "id", F.lit(0).alias("lane")),
        match.select("query_id", "id", F.lit(1).alias("lane")),
        near.distinct().join(symbols, "file_path").select("query_id", "id", F.lit(2).alias("lane")),
    ]
    return reduce(DataFrame.unionAll, lanes).groupBy("query_id", "id").agg(F.min("lane").alias("lane"))


def coverage_bonus(share: Column, least: float = 0.6, most: float = 20.0) -> Column:
    """Points for the share of query tokens that a text holds: none below the limit, then linear."""
    return F.when(share >= least, (share - least) / (1 - least) * most).otherwise(F.lit(0.0))


def semantic_search(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Dense results (query_id, id, score) raised by .06 if found lexically too; lexical-only ones at .35 of theirs."""
    lex = lexical.select("query_id", "id", F.col("score").alias("lex"))
    both = dense.join(lex, ["query_id", "id"], "full")
    score = F.when(F.col("score").isNull(), F.col("lex") / 100 * 0.35).otherwise(
        F.col("score") + F.when(F.col("lex").isNotNull(), 0.06).otherwise(0.0)
    )
    return rank.top_k(both.select("query_id", "id", F.round(score, 6).alias("score")), k, "score", "id")


def dead_code_report(dead: DataFrame, symbols: DataFrame, vectors: DataFrame, scope: str, k: int = 10, least: float = 0.15) -> DataFrame:
    """(id, name, file_path, live, score): the first dead symbols of a scope, each with up to three live ones like it."""
    top = dead.where(F.contains("file_path", F.lit(scope))).orderBy("file_path", "name", "id").limit(k)
    live = vectors.join(symbols.join(dead.select("id"), "id", "left_anti").select("id"), "id", "left_semi")
    asked = top.join(vectors, "id").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))  # at most k
    near = vector.knn(live, asked, 3).where(F.col("score") > least)
    return top.join(near.select(F.col("query_id").alias("id"), F.col("id").alias("live"), "score"), "id", "left")


def missing_imports(used: DataFrame, symbols: DataFrame, imports: DataFrame, builtin: DataFrame, most: int = 3) -> DataFrame:
    """(caller_file, name, candidate, confidence): where names that a file uses could come from.

    Names are left out that the file defines, that a file it imports defines, or that are built in.
    """
    s = symbols.select("file_path", "name").distinct()
    used = used.distinct().join(builtin.select("name"), "name", "left_anti")
    local = s.select(F.col("file_path").alias("caller_file"), "name")
    imported = imports.join(s, F.col("dst") == F.col("file_path")).select(F.col("src").alias("caller_file"), "name")
    open_ = used.join(local.unionAll(imported), ["caller_file", "name"], "left_anti")
    # a name's first files are cut before they are dealt, and before they meet the uses
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("file_path"))).where(F.col("r") <= most)
    count = s.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    first = ranked.select("name", F.col("file_path").alias("candidate")).join(count, "name")
    return open_.join(first, "name").select(
        "caller_file", "name", "candidate", F.when(F.col("n") == 1, 0.95).otherwise(0.7).alias("confidence")
    )


def code_review(rows: DataFrame, changed: DataFrame, k: int = 3) -> DataFrame:
    """(id, twin, score): for the rows of changed files, similar ones elsewhere."""
    inside = rows.join(small(changed), "file_path", "left_semi").select("id")
    near = vector.similar(rows, inside, k)
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("twin"), "score")


#: Definitions and references beyond which a change needs care, and beyond which it is blocked.
MANY_DEFINITIONS, MANY_REFERENCES = (1, 5), (20, 100)


def readiness(changed: DataFrame, definitions: DataFrame, references: DataFrame, tests: DataFrame) -> DataFrame:
    """(subject, diagnostics, refs, tests, mutation): ready, caution or blocked on each axis, and over all.

    Diagnostics go by how many definitions a name has, references by their number, tests by whether one names it.
    """
    count = lambda df, name: df.groupBy("subject").agg(F.count(F.lit(1)).alias(name))
    rows = changed.select("subject").distinct().join(count(definitions, "d"), "subject", "left").join(count(references, "r"), "subject", "left")
    rows = rows.join(tests.select("subject").distinct().withColumn("t", F.lit(True)), "subject", "left")

    def axis(n: Column, limits: tuple[int, int]) -> Column:
        return F.when(n > limits[1], "blocked").when(n > limits[0], "caution").otherwise("ready")

    rows = rows.select(
        "subject",
        axis(F.coalesce("d", F.lit(0)), MANY_DEFINITIONS).alias("diagnostics"),
        axis(F.coalesce("r", F.lit(0)), MANY_REFERENCES).alias("refs"),
        F.when(F.col("t"), "ready").otherwise("caution").alias("tests"),
    )
    worst = F.array("diagnostics", "refs", "tests")
    overall = F.when(F.array_contains(worst, "blocked"), "blocked").when(F.array_contains(worst, "caution"), "caution").otherwise("ready")
    return rows.withColumn("mutation", overall)


def unresolved(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, uses, exact, status): whether each used name has exactly one definition, several or none."""
    u = uses.groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    d = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("exact"))
    n = F.coalesce("exact", F.lit(0))
    return u.join(d, "name", "left").select(
        "name", "uses", n.cast("long").alias("exact"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing").alias("status")
    )


def occurrences_at(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """Definitions of the symbol at each point (file, line; or file, line, symbol): an index of (file, line, symbol, role)
    joined to itself by symbol.  Each is once in the result, as it is once in both sides, which are far less."""
    keys = [c for c in ("file", "line", "symbol") if c in points.columns]
    at = points.select(*keys).distinct().join(occurrences.select("file", "line", "symbol").distinct(), keys)
    defs = occurrences.where("role = 'definition'").select("symbol", F.col("file").alias("def_file"), F.col("line").alias("def_line")).distinct()
    return at.join(defs, "symbol").select("file", "line", "symbol", "def_file", "def_line")


def artifacts(rows: DataFrame, now: int, ttl: int, keep: int) -> DataFrame:
    """Artifacts (id, created) younger than their time to live, the newest ``keep``."""
    return rows.where(F.col("created") > now - ttl).orderBy(F.col("created").desc(), "id").limit(keep)


MARKERS = {"Cargo.toml": "rust", "package.json": "javascript", "pyproject.toml": "python", "go.mod": "go", "pom.xml": "java"}


def workspaces(files: DataFrame) -> DataFrame:
    """(root, kind): directories that hold a package marker."""
    name = F.element_at(F.split("relative_path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])
    return files.where(name.isin(*MARKERS)).select(T.directory(F.col("relative_path")).alias("root"), kinds[name].alias("kind")).distinct()


def dominant_language(files: DataFrame) -> DataFrame:
    """(root, language, files): the language that most files below each first folder are written in; ties by name."""
    root = F.when(F.contains("relative_path", F.lit("/")), F.split("relative_path", "/")[0]).otherwise(F.lit("."))
    known = F.create_map(*[F.lit(x) for kv in lookup.LANGUAGES.items() for x in kv])
    rows = files.select(root.alias("root"), known[T.extension(F.col("relative_path"))].alias("language")).where("language IS NOT NULL")
    n = rows.groupBy("root", "language").agg(F.count(F.lit(1)).alias("files"))
    best = n.groupBy("root").agg(F.min(F.struct((-F.col("files")).alias("o"), "language")).alias("m"))
    return best.select("root", F.col("m.language").alias("language"), (-F.col("m.o")).alias("files"))


def bridged(queries: DataFrame, bridges: DataFrame) -> DataFrame:
    """(query_id, term): code terms (word, term) for the words of each query."""
    words = queries.select("query_id", F.explode(F.split(F.lower("query"), "[^a-z0-9]+")).alias("word"))
    return bridges.join(batch(words), "word").select("query_id", "term").distinct()


def analyzed(queries: DataFrame) -> DataFrame:
    """(query_id, class, lexical_only, prefer_sparse): how a query wants to be searched."""
    words = F.size(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != ""))
    toks = F.size(T.query_tokens(F.col("query")))
    return queries.select(
        "query_id", rank.query_class(F.col("query")).alias("class"), ((words == 1) & F.col("query").rlike("^[A-Za-z0-9_]+$")).alias("lexical_only"),
        toks.between(2, 4).alias("prefer_sparse"),
    )


def expanded(queries: DataFrame, aliases: list[tuple[tuple[str, ...], tuple[str, ...]]] | None = None) -> DataFrame:
    """(query_id, term): a query as it is, with its words joined as identifiers, its own identifier in other cases, and aliases.

    Two to six words of three characters or more are joined in twos and threes in snake case, and all in camel and
    Pascal case.  ``aliases`` are a project's own: the terms of a rule come in if a query has all of its words.
    """
    none = F.array().cast("array<string>")
    title = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    q = F.trim("query")
    words = F.filter(F.split(F.lower(q), r"\s+"), lambda x: F.length(x) > 2)
    camel = lambda w, rest: F.concat(w[0], F.array_join(F.transform(F.slice(w, 2, F.size(w)), rest), ""))

    def grams(w: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), "_"))
        return F.when(F.size(w) >= n, each).otherwise(none)

    def of_words(w: Column) -> Column:
        both = F.concat(grams(w, 2), grams(w, 3), F.array(camel(w, title), F.array_join(F.transform(w, title), "")))
        return F.when(F.size(w).between(2, 6), both).otherwise(none)

    parts = F.filter(F.split(q, "_"), lambda x: x != "")
    from_snake = F.transform(F.array(parts), lambda w: F.concat(F.lower(w[0]), F.array_join(F.transform(F.slice(w, 2, F.size(w)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")))
    snake = F.when(F.contains(q, F.lit("_")) & ~F.contains(q, F.lit(" ")) & (F.size(parts) > 0), from_snake).otherwise(none)
    lowered = F.lower(F.regexp_replace(q, r"(?<=.)(\p{Lu})", "_$1"))
    from_camel = F.when(q.rlike(r"\p{Lu}") & ~F.contains(q, F.lit(" ")), F.array(lowered)).otherwise(none)
    own = [
        F.when(reduce(lambda x, y: x & y, [F.contains(F.lower(q), F.lit(w)) for w in need]), F.array(*[F.lit(t) for t in terms])).otherwise(none)
        for need, terms in aliases or []
    ]
    terms = F.concat(F.array(q), T.let(words, of_words), snake, from_camel, *own)
    return queries.select("query_id", F.explode(F.array_distinct(terms)).alias("term"))


#: Importers that a report lists of each file.
IMPORTERS = 20


def importers(edges: DataFrame, roots: DataFrame, most: int = IMPORTERS) -> DataFrame:
    """(root, importer, limit_hit): the first importers of each root, and whether there are more."""
    rows = edges.join(small(roots.select(F.col("root").alias("dst"))), "dst").select(F.col("dst").alias("root"), F.col("src").alias("importer")).distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("importer"))).where(F.col("n") <= most + 1)
    hit = ranked.groupBy("root").agg((F.max("n") > most).alias("limit_hit"))
    return ranked.where(F.col("n") <= most).drop("n").join(hit, "root").select("root", "importer", "limit_hit")


def impact(edges: DataFrame, symbols: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, file, depth, symbol_count): what a change of each root may reach, and how many symbols each such file has."""
    counts = symbols.groupBy(F.col("file").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return graph.reach(edges, roots, depth).join(counts, "node", "left").select(
        "root", F.col("node").alias("file"), "depth", F.coalesce("n", F.lit(0)).cast("long").alias("symbol_count")
    )


#: Least strength and number of joint commits, and least likeness, that a boundary report lists.
COUPLED, TOGETHER, ALIKE = 0.3, 3, 0.12


def boundary(
    edges: DataFrame, symbols: DataFrame, commits: DataFrame, alike: DataFrame, root: DataFrame, coupled: float = COUPLED, together: int = TOGETHER
) -> DataFrame:
    """(section, item, value): what crosses a file's boundary: files that a change reaches within two steps, the cycle
    that it is in, files that change with it, and up to five others that are most like it (file, other, score)."""
    reached = impact(edges, symbols, root, 2).select(F.lit("affected").alias("section"), F.col("file").cast("string").alias("item"), F.col("depth").cast("double").alias("value"))
    loops = graph.cycles(edges)
    own = loops.join(root.select(F.col("root").alias("node")), "node").select("component")
    ring = loops.join(own, "component").join(root.select(F.col("root").alias("node")), "node", "left_anti")
    ring = ring.select(F.lit("cycle"), F.col("node").cast("string"), F.lit(1.0))
    with_ = graph.coupling(commits, together, coupled)
    r = root.select(F.col("root").alias("r"))
    pairs = with_.join(r, F.col("r") == F.col("file_a")).select(F.col("file_b").alias("f"), "strength")
    pairs = pairs.unionAll(with_.join(r, F.col("r") == F.col("file_b")).select("file_a", "strength"))
    joint = pairs.select(F.lit("coupled"), F.col("f").cast("string"), F.round("strength", 6))
    near = alike.join(root.select(F.col("root").alias("file")), "file").where((F.col("score") > ALIKE) & (F.col("other") != F.col("file")))
    near = near.orderBy(F.col("score").desc(), "other").limit(5).select(F.lit("alike"), F.col("other").cast("string"), "score")
    return reduce(DataFrame.unionAll, [reached, ring, joint, near])


def refactor_safety(edges: DataFrame, symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(file, name, callers, affected, risk) of each symbol (name, file) of some files: who calls it, and how far its file reaches."""
    mine = symbols.join(small(files.select("file").distinct()), "file").select("file", "name").distinct()
    n = calls.groupBy(F.col("callee_name").alias("name")).agg(F.countDistinct("caller_file").alias("callers"))
    far = graph.reach(edges, files.select(F.col("file").alias("root")).distinct(), 2).groupBy(F.col("root").alias("file")).agg(F.count(F.lit(1)).alias("affected"))
    rows = mine.join(n, "name", "left").join(far, "file", "left").na.fill(0, ["callers", "affected"])
    risk = F.when((F.col("callers") > MANY_REFERENCES[0]) | (F.col("affected") > MANY_REFERENCES[1]), "high").when(F.col("callers") > 0, "medium").otherwise("low")
    return rows.select("file", "name", "callers", "affected", risk.alias("risk"))


def safe_rename(symbols: DataFrame, calls: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, new_name, definitions, references, collisions, status) of each rename (name, new_name).

    Blocked if a file that defines the name has the new one already, or nothing defines it; caution if several do.
    """
    asked = small(renames.select("name", "new_name").distinct())
    defs = symbols.join(asked, "name").select("name", "new_name", "file_path").distinct()
    d = defs.groupBy("name", "new_name").agg(F.count(F.lit(1)).alias("definitions"))
    c = defs.join(symbols.select(F.col("name").alias("new_name"), "file_path").distinct(), ["new_name", "file_path"])
    c = c.groupBy("name", "new_name").agg(F.count(F.lit(1)).alias("collisions"))
    r = calls.join(asked, F.col("callee_name") == F.col("name")).groupBy("name", "new_name").agg(F.count(F.lit(1)).alias("references"))
    keys = ["name", "new_name"]
    rows = renames.select(*keys).distinct().join(d, keys, "left").join(r, keys, "left").join(c, keys, "left")
    rows = rows.na.fill(0, ["definitions", "references", "collisions"])
    status = F.when((F.col("collisions") > 0) | (F.col("definitions") == 0), "blocked").when(F.col("definitions") > 1, "caution").otherwise("ready")
    return rows.select(*keys, "definitions", "references", "collisions", status.alias("status"))


def change_request(ranked: DataFrame, docs: DataFrame, changed: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, file_path, changed, rank): files to look at for each request, changed ones first, without tests and benchmarks."""
    hits = ranked.join(docs.select("id", "file_path"), "id").groupBy("query_id", "file_path").agg(F.min("rank").alias("first"))
    new = changed.select("file_path").distinct().withColumn("changed", F.lit(True))
    rows = hits.join(new, "file_path", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    rows = rows.where(~T.is_test_path(F.col("file_path")) & ~F.col("file_path").rlike("(^|/)(bench|benches|benchmarks)/"))
    by = Window.partitionBy("query_id").orderBy(F.col("changed").desc(), "first", "file_path")
    return rows.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= most).select("query_id", "file_path", "changed", "rank")
