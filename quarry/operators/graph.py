"""Graphs as edge tables: importance, reachability, cycles, dead code, calls, types, change coupling.

Loops run on the driver, but only counts come back to it; each round's table is cut from its lineage with
``checkpoint``, so that a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.storage import shared_dir, written

DAMPING, ROUNDS = 0.85, 20


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


#: Edges out of one node that are kept under one key.
BLOCK = 65_536


def pagerank(edges: DataFrame, indexed: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(node, score) after a fixed number of synchronous rounds.

    Out-degrees count edges to targets that are not indexed; what leaves that way, or from nodes without
    edges, is lost and not handed out again.  The edge table is laid out and sorted by source once, with its
    out-degrees, and an edge of no weight from each node to itself, so that every node has a sum.  A round moves
    one row a node.  If some source has more edges than fit a block, blocks are part of the key.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = written(edges.select("src", "dst"), "rank-edges")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    blocks = F.ceil(F.col("out") / BLOCK).cast("int")
    known = (indexed if indexed is not None else nodes(edges)).select(F.col("node").alias("dst")).distinct()
    known = known.join(degree.select(F.col("src").alias("dst"), blocks.alias("k")), "dst", "left")
    known = written(known.select("dst", F.coalesce("k", F.lit(1)).alias("k")), "rank-nodes")
    n, most = known.agg(F.count(F.lit(1)), F.max("k")).first()
    keys = ["src", "s"] if (most or 1) > 1 else ["src"]
    real = edges.join(degree, "src").join(known, "dst").select(
        "src", "dst", "k", (1 / F.col("out")).alias("part"), F.pmod(F.xxhash64("dst"), blocks).cast("int").alias("s")
    )
    own = known.select(F.col("dst").alias("src"), "dst", "k", F.lit(0.0).alias("part"), F.lit(0).alias("s"))
    laid = real.unionAll(own).repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint()
    base = (1 - DAMPING) / max(n, 1)
    rank = known.select(F.col("dst").alias("src"), "k", F.lit(1.0 / max(n, 1)).alias("score"))
    for i in range(rounds):
        sent = rank.select("src", "score", *([F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s")] if len(keys) > 1 else []))
        into = laid.join(sent, keys).groupBy(F.col("dst").alias("src")).agg(F.max("k").alias("k"), F.sum(F.col("score") * F.col("part")).alias("in"))
        rank = into.select("src", "k", (F.lit(base) + DAMPING * F.col("in")).alias("score"))
        if i % 5 == 4:
            rank = rank.checkpoint()
    return rank.select(F.col("src").alias("node"), "score")


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes reached from each root against the import direction, at least depth.

    A round is a table of its own, so that nodes reached before are read but never written again; so are the
    edges, which each round reads.
    """
    back = written(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")), "reach-edges")
    rounds = [written(start.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")).distinct(), "reach")]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionAll, rounds).select("root", "node")
        new = written(
            rounds[-1]
            .join(back, "node")
            .select("root", F.col("next").alias("node"))
            .distinct()
            .join(seen, ["root", "node"], "left_anti")
            .withColumn("depth", F.lit(d).cast("long")),
            "reach",
        )
        if new.isEmpty():
            break
        rounds.append(new)
    return reduce(DataFrame.unionAll, rounds).where("depth > 0")


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: What is left of a graph after its rounds is one task's work at so many edges (16 bytes each).
RESIDUE = 100_000


def _strong(batches):
    """(node, component) of a whole edge list: depth-first search with low links, without recursion."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    names, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    src, dst = ends[: table.num_rows], ends[table.num_rows :]
    order = np.argsort(src, kind="stable")
    next_, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(len(names) + 1)).tolist()
    seen, low, at = [0] * len(names), [0] * len(names), first[:-1].copy()
    open_, held, clock, found = [], [False] * len(names), 0, ([], [])
    for root in range(len(names)):
        path = [] if seen[root] else [root]
        while path:
            n = path[-1]
            if not seen[n]:
                clock += 1
                seen[n] = low[n] = clock
                open_.append(n)
                held[n] = True
            if at[n] < first[n + 1]:
                m = next_[at[n]]
                at[n] += 1
                if not seen[m]:
                    path.append(m)
                elif held[m]:
                    low[n] = min(low[n], seen[m])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[n])
            if low[n] == seen[n]:
                group = []
                while not group or group[-1] != n:
                    group.append(open_.pop())
                    held[group[-1]] = False
                if len(group) > 1:
                    found[0].extend(group)
                    found[1].extend([min(group)] * len(group))
    kind = table.schema.field("src").type
    yield pa.RecordBatch.from_arrays([pa.array(names[np.array(x, np.int64)], kind) for x in found], ["node", "component"])


def cycles(edges: DataFrame, residue: int = RESIDUE, max_rounds: int = 200) -> DataFrame:
    """(node, component): strongly connected components of two nodes or more, named by their least node.

    Rounds cut the graph down, whatever its size.  Nodes with one edge in are merged into where it comes from,
    and, the other way round, nodes with one edge out: trees, chains and rings vanish in a number of steps that
    grows with the logarithm of their length.  When too few such nodes are left, the least ancestor and, among
    nodes that share it, the least descendant are spread; nodes whose both are one and the same node are its
    component, and edges between nodes with different ancestors go.  A last residue of few edges is searched in
    depth.  If rounds do not get there, that is an error.
    """
    shared_dir(edges.sparkSession)
    e = written(edges.select("src", "dst").where("src <> dst").distinct(), "cycle-edges")
    found = written(_components(e, residue, max_rounds), "cycles")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _components(e: DataFrame, residue: int, left: int, tries: int = 0) -> DataFrame:
    """(node, component) of nodes on cycles; a component is named by any one of its nodes."""
    kind = dict(e.dtypes)["src"]
    if e.count() <= residue:
        return e.repartition(1).mapInArrow(_strong, f"node {kind}, component {kind}")
    if left == 0:
        raise RuntimeError("the graph is still too large after its rounds")
    e = _trim(e, 2)
    n = e.count()
    if n <= residue:
        return _components(e, residue, left)
    if tries < 2:
        levels = _forest(e)
        if levels and levels[0].count() * 10 >= n:
            return _merged(e, levels, residue, left)
        return _components(written(flip(e), "cycle-edges"), residue, left, tries + 1)
    colour = _propagate(e, nodes(e).select("node", F.col("node").alias("c")))
    same = _within(e, colour)
    back = _propagate(flip(same), nodes(same).select("node", F.col("node").alias("c")))
    part = colour.join(back, ["node", "c"])
    many = part.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
    found = written(part.join(many, "c", "left_semi").select("node", F.col("c").alias("component")), "cycles")
    gone = part.select("node").checkpoint()
    rest = (
        _within(same, back)
        .join(gone.select(F.col("node").alias("src")), "src", "left_anti")
        .join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    )
    return found.unionAll(_components(written(rest, "cycle-edges"), residue, left - 1))


def _within(e: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges between nodes of one colour."""
    a = colour.select(F.col("node").alias("src"), F.col("c").alias("a"))
    b = colour.select(F.col("node").alias("dst"), F.col("c").alias("b"))
    return written(e.join(a, "src").join(b, "dst").where("a = b").select("src", "dst"), "cycle-edges")


def _forest(e: DataFrame) -> list[DataFrame]:
    """Nodes with one edge in: tables (node, up) of their ancestors 1, 2, 4, ... steps up, or roots if those are nearer.

    Where such nodes form a ring, the least of them is made a root: it is the one that is the least of the
    ancestors on its own way.
    """
    lone = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up")).where("n = 1")
    parent = written(lone.select("node", "up"), "forest")
    if parent.isEmpty():
        return []
    heads, jump, levels = [], parent.withColumn("least", F.col("up")), [parent]
    while True:
        a, b = jump.alias("a"), jump.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("least").alias("more"))
        new = written(
            a.join(b, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up"), F.least("least", "more").alias("least"), F.col("next").isNotNull().alias("moved")
            ),
            "forest",
        )
        seen = new.agg(F.count_if("moved").alias("moved"), F.count_if(F.col("least") == F.col("node")).alias("heads")).first()
        if not seen["moved"]:
            break
        jump = new.select("node", "up", "least")
        levels.append(new.select("node", "up"))
        if seen["heads"]:
            heads.append(jump.where("least = node").select("node"))
            jump = jump.join(heads[-1].select(F.col("node").alias("least")), "least", "left_anti")
    if not heads:
        return levels
    cut = written(parent.join(reduce(DataFrame.unionAll, heads), "node", "left_anti"), "forest")
    levels = [cut]
    while True:
        b = levels[-1].select(F.col("node").alias("up"), F.col("up").alias("next"))
        new = levels[-1].join(b, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        new = written(new, "forest")
        if new.where("moved").isEmpty():
            return levels
        levels.append(new.select("node", "up"))


def _merged(e: DataFrame, levels: list[DataFrame], residue: int, left: int) -> DataFrame:
    """Components of a graph whose trees are merged into their roots, and of the trees.

    Edges that are not of a tree lead to roots.  A node of a tree is in the component of its root if an edge
    leads from it, or from a node below, to a root of that component.
    """
    tree = levels[-1].select("node", F.col("up").alias("root"))
    rest = e.join(levels[0].select(F.col("up").alias("src"), F.col("node").alias("dst")), ["src", "dst"], "left_anti")
    rest = rest.join(tree.withColumnRenamed("node", "src"), "src", "left").select("src", "dst", F.coalesce("root", "src").alias("root"))
    rest = written(rest, "cycle-edges")
    small = written(rest.where("root <> dst").select(F.col("dst").alias("src"), F.col("root").alias("dst")).distinct(), "cycle-edges")
    inner = written(_components(small, residue, left - 1), "cycles")
    a = inner.select(F.col("node").alias("root"), F.col("component").alias("a"))
    b = inner.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    on = rest.join(a, "root", "left").join(b, "dst", "left").where("root = dst or a = b").select(F.col("src").alias("node")).distinct()
    on = written(on, "cycles")
    for level in levels:
        on = written(on.unionAll(on.join(level, "node").select(F.col("up").alias("node"))).distinct(), "cycles")
    named = on.join(tree, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return named.join(a, "root", "left").select("node", F.coalesce("a", "root").alias("component"))


def _trim(e: DataFrame, most: int = 8) -> DataFrame:
    """Drops edges from nodes without an edge in, and to nodes without one out, in a few passes."""
    n = e.count()
    for _ in range(most):
        e = (
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            .checkpoint()
        )
        left = e.count()
        if left == n:
            break
        n = left
    return e


def _propagate(e: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, c): the least node over all ancestors, a node's own included.

    An ancestor's least ancestor is one of the node too, so that a round also jumps to what the colour itself has.
    """
    colour = written(colour, "colour")
    while True:
        sent = colour.select(F.col("node").alias("src"), "c")
        into = e.join(sent, "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        near = colour.join(into, "node", "left").select("node", F.col("c").alias("was"), F.least("c", "m").alias("near"))
        over = colour.select(F.col("node").alias("near"), F.col("c").alias("far"))
        new = near.join(over, "near", "left").select("node", F.least("near", "far").alias("c"), "was")
        new = written(new, "colour")
        if new.where("c < was").isEmpty():
            return new.select("node", "c")
        colour = new.select("node", "c")


def adjacency(edges: DataFrame, indexed: DataFrame) -> DataFrame:
    """(node, n_imports, n_imported_by): imports keep targets that are not indexed, imported_by does not."""
    out = edges.distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_imports"))
    into = (
        edges.distinct()
        .join(indexed.select(F.col("node").alias("dst")), "dst", "left_semi")
        .groupBy(F.col("dst").alias("node"))
        .agg(F.count(F.lit(1)).alias("n_imported_by"))
    )
    zero = F.lit(0).cast("long")
    return indexed.select("node").join(out, "node", "left").join(into, "node", "left").select(
        "node", F.coalesce("n_imports", zero).alias("n_imports"), F.coalesce("n_imported_by", zero).alias("n_imported_by")
    )


#: Files of one commit that are paired in one task.
COMMIT_BLOCK = 256


def coupling(commits: DataFrame, min_commits: int = 3, min_strength: float = 0.0, limit: int = 0) -> DataFrame:
    """File pairs that change together: co-changes over the larger of their totals.

    Pairs are made per commit, as the definition asks, and only of files with enough commits.  A commit of more
    than ``COMMIT_BLOCK`` files is cut into blocks, each two of which meet under a key of their own.
    """
    once = commits.select("commit_id", "file").distinct()
    totals = once.groupBy("file").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= min_commits)
    often = written(once.join(totals, "file"), "coupling")
    blocks = often.groupBy("commit_id").agg(F.ceil(F.count(F.lit(1)) / COMMIT_BLOCK).cast("int").alias("g"))
    often = often.join(blocks.where("g > 1"), "commit_id", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    often = often.withColumn("b", F.pmod(F.xxhash64("file"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    a = often.select("commit_id", F.col("b").alias("i"), other.alias("j"), F.col("file").alias("file_a"), F.col("total").alias("total_a"))
    b = often.select("commit_id", other.alias("i"), F.col("b").alias("j"), F.col("file").alias("file_b"), F.col("total").alias("total_b"))
    pairs = a.join(b, ["commit_id", "i", "j"]).where("file_a < file_b")
    counted = pairs.groupBy("file_a", "file_b", "total_a", "total_b").agg(F.count(F.lit(1)).alias("co_changes"))
    out = counted.withColumn(
        "strength", F.col("co_changes") / F.greatest("total_a", "total_b").cast("double")
    ).where((F.col("co_changes") >= min_commits) & (F.col("strength") >= min_strength))
    return out.orderBy(F.col("strength").desc(), "file_a", "file_b").limit(limit) if limit else out


def trace(edges: DataFrame, root: str, depth: int = 3, limit: int = 20) -> DataFrame:
    """(side, node, depth): callers and callees of a function, the nearest ``limit`` of each side."""
    start = edges.sparkSession.createDataFrame([(root,)], "root string")

    def side(name: str, e: DataFrame) -> DataFrame:
        near = reach(e, start, depth).orderBy("depth", "node").limit(limit)
        return near.select(F.lit(name).alias("side"), "node", "depth")

    return side("callers", edges).unionAll(side("callees", flip(edges)))


# Files and symbols that something outside the code calls.
ENTRY_FILES = ("__init__.py", "mod.rs", "lib.rs", "main.rs", "index.ts", "index.js", "index.tsx", "index.jsx")
ENTRY_SYMBOLS = ("main", "__init__", "setUp", "tearDown", "<module>")
CONFIG_FILES = r"\.(toml|yml|yaml|json)$"


def is_entry_file(path) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*ENTRY_FILES)


def dead_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Files that nothing imports, but entry points and configuration."""
    alone = files.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    return alone.where(~is_entry_file(F.col("path")) & ~F.lower("path").rlike(CONFIG_FILES))


def dead_symbols(symbols: DataFrame, calls: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Functions and methods that no call names, but entry points, tests and decorated ones.

    ``skip`` has files (file_path) that are dead as a whole; their symbols, and those of entry files, are left out.
    """
    called = calls.select(F.col("callee_name").alias("name")).distinct()
    entry = F.col("name").isin(*ENTRY_SYMBOLS) | F.col("name").rlike("^(test_|Test)") | is_entry_file(F.col("file_path"))
    if "decorated" in symbols.columns:
        entry = entry | F.coalesce("decorated", F.lit(False))
    rows = symbols.where(F.col("kind").isin("function", "method") & ~entry)
    if skip is not None:
        rows = rows.join(skip.select("file_path").distinct(), "file_path", "left_anti")
    return rows.join(called, "name", "left_anti")


def dead_code(symbols: DataFrame, calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(pass, file, symbol): files that nothing imports, then symbols of the others that nothing calls."""
    files = symbols.select(F.col("file_path").alias("node"), F.col("file_path").alias("path")).distinct()
    lone = dead_files(edges, files).select(F.col("path").alias("file_path"))
    two = dead_symbols(symbols, calls, lone)
    return lone.select(F.lit(1).cast("long").alias("pass"), F.col("file_path").alias("file"), F.lit(None).cast("string").alias("symbol")).unionAll(
        two.select(F.lit(2).cast("long"), "file_path", "name")
    )


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """File edges rolled up to modules: (from_module, to_module, file_pair_count)."""
    a = modules.select(F.col("node").alias("src"), F.col("module").alias("from_module"))
    b = modules.select(F.col("node").alias("dst"), F.col("module").alias("to_module"))
    return (
        edges.distinct()
        .join(a, "src")
        .join(b, "dst")
        .where("from_module <> to_module")
        .groupBy("from_module", "to_module")
        .agg(F.count(F.lit(1)).alias("file_pair_count"))
    )


def leaks(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, inside, outgoing, leak): a module's edges that stay in it, those that leave it, and their share."""
    a = modules.select(F.col("node").alias("src"), "module")
    b = modules.select(F.col("node").alias("dst"), F.col("module").alias("other"))
    rows = edges.distinct().join(a, "src").join(b, "dst").groupBy("module").agg(
        F.count_if(F.col("module") == F.col("other")).alias("inside"), F.count_if(F.col("module") != F.col("other")).alias("outgoing")
    )
    return rows.withColumn("leak", F.round(F.col("outgoing") / (F.col("inside") + F.col("outgoing")), 6))


def mermaid(rollup: DataFrame, limit: int = 20) -> DataFrame:
    """One text: the strongest module edges as a diagram."""
    top = rollup.orderBy(F.col("file_pair_count").desc(), "from_module", "to_module").limit(limit)
    line = F.concat(
        F.lit("  "), "from_module", F.lit(" -->|"), F.col("file_pair_count").cast("string"), F.lit("| "), "to_module"
    )
    listed = F.sort_array(F.collect_list(F.struct((-F.col("file_pair_count")).alias("o"), line.alias("t"))))
    return top.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.transform(listed, lambda x: x["t"]), "\n")).alias("diagram"))
