import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import edits, evaluation, graph, lookup, notebook, rank, telemetry, types, vector


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_blast_radius_of_three_files(spark):
    e = edges(spark, ("main", "utils"), ("utils", "models"))
    got = graph.reach(e, spark.createDataFrame([("models",)], "root string"), 3).collect()
    assert sorted((r.depth, r.node) for r in got) == [(1, "utils"), (2, "main")]


def test_cycles_are_components_of_two_or_more(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("x", "y"), ("y", "x"), ("d", "x"))
    assert sorted(tuple(r) for r in graph.cycles(e).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert graph.cycles(edges(spark, ("a", "b"), ("b", "c"))).count() == 0


def test_cycles_of_random_graphs_match_mutual_reachability(spark):
    rnd = random.Random(2)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)}
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach}
    sizes = {c: sum(v == c for v in want.values()) for c in want.values()}
    e = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = {x: c for x, c in want.items() if sizes[c] > 1}
    assert {r.node: r.component for r in graph.cycles(e).collect()} == want
    assert {r.node: r.component for r in graph.cycles(e, residue=0).collect()} == want  # by rounds, to the end


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_by_rounds_of_graphs_without_chains(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "_forest", lambda e: [])
    rnd = random.Random(seed)
    e = spark.createDataFrame(sorted({(rnd.randrange(60), rnd.randrange(60)) for _ in range(110)}), "src long, dst long")
    want = {tuple(r) for r in graph.cycles(e).collect()}
    assert len(want) > 3 and {tuple(r) for r in graph.cycles(e, residue=0).collect()} == want


def test_long_chains_rings_and_trees_take_few_rounds(spark, monkeypatch):
    n = 20_000
    i = F.col("id")
    chain = spark.range(n).select(i.alias("src"), (i + 1).alias("dst"))
    ring = spark.range(n).select((i + 100_000).alias("src"), ((i + 1) % n + 100_000).alias("dst"))
    tree = spark.range(1, n).select((F.floor(i / 2) + 200_000).alias("src"), (i + 200_000).alias("dst"))
    loops = spark.createDataFrame([(100_007, 0), (100_009, 200_001), (219_999, 200_001), (300_000, 300_001), (300_001, 300_000)], "src long, dst long")
    rounds = []
    plain = graph._components
    monkeypatch.setattr(graph, "_components", lambda *a: rounds.append(1) or plain(*a))
    got = {r.node: r.component for r in graph.cycles(chain.unionAll(ring).unionAll(tree).unionAll(loops), residue=0).collect()}
    up, x = set(), 19_999
    while x:
        up.add(200_000 + x)
        x //= 2
    want = {100_000 + k: 100_000 for k in range(n)} | dict.fromkeys(up, 200_001) | {300_000: 300_000, 300_001: 300_000}
    assert got == want and len(rounds) <= 8


def test_cycles_fixtures(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"))
    assert {(r.node, r.component) for r in graph.cycles(ring).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert graph.cycles(edges(spark, ("a", "b"), ("b", "c"))).count() == 0 and graph.cycles(ring.limit(0)).count() == 0
    long = spark.createDataFrame([(i, (i + 1) % 3000) for i in range(3000)], "src long, dst long")
    assert {r.component for r in graph.cycles(long).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.cycles(ring, residue=0, max_rounds=0)


def test_dead_code_passes_and_exemptions(spark):
    symbols = spark.createDataFrame(
        [("used", "function", "a.py", False), ("lone", "function", "b.py", False), ("dead", "method", "a.py", False), ("wired", "function", "a.py", True),
         ("test_x", "function", "a.py", False), ("main", "function", "a.py", False), ("C", "class", "a.py", False), ("idle", "function", "main.rs", False)],
        "name string, kind string, file_path string, decorated boolean",
    )
    calls = spark.createDataFrame([("used",)], "callee_name string")
    got = {tuple(r) for r in graph.dead_code(symbols, calls, edges(spark, ("z.py", "a.py"))).collect()}
    assert got == {(1, "b.py", None), (2, "a.py", "dead")}


def test_trace_stops_at_a_depth_and_a_number(spark):
    e = edges(spark, *[(f"c{i:02}", "f") for i in range(30)], ("f", "g"), ("g", "h"), ("h", "i"), ("i", "j"))
    got = [tuple(r) for r in graph.trace(e, "f").orderBy("side", "depth", "node").collect()]
    assert [g for g in got if g[0] == "callees"] == [("callees", "g", 1), ("callees", "h", 2), ("callees", "i", 3)]
    assert [g[1] for g in got if g[0] == "callers"] == [f"c{i:02}" for i in range(20)]


def test_large_commits_are_cut_into_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(c, f"f{i}") for c in range(3) for i in range(40)], "commit_id long, file string")
    want = {tuple(r) for r in graph.coupling(rows).collect()}
    monkeypatch.setattr(graph, "COMMIT_BLOCK", 7)
    assert {tuple(r) for r in graph.coupling(rows).collect()} == want and len(want) == 40 * 39 // 2


def test_pagerank_leaks_to_targets_that_are_not_indexed(spark):
    e = edges(spark, ("a", "b"), ("a", "external"))
    known = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {r.node: r.score for r in graph.pagerank(e, known).collect()}
    assert graph.pagerank(e.limit(0)).count() == 0
    assert got["a"] == pytest.approx(0.075) and got["b"] == pytest.approx(0.075 + 0.85 * 0.075 / 2)
    assert sum(got.values()) < 1


def test_pagerank_equals_plain_rounds_with_busy_sources_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    pairs = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(150)} | {(0, x) for x in range(40)})
    names = sorted({x for p in pairs for x in p})
    out = {x: sum(a == x for a, _ in pairs) for x in names}
    want = dict.fromkeys(names, 1 / len(names))
    for _ in range(graph.ROUNDS):
        into = dict.fromkeys(names, 0.0)
        for a, b in pairs:
            into[b] += want[a] / out[a]
        want = {x: 0.15 / len(names) + 0.85 * into[x] for x in names}
    monkeypatch.setattr(graph, "BLOCK", 7)
    got = graph.pagerank(spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert {r.node: r.score for r in got} == pytest.approx(want)


def test_coupling(spark):
    rows = [(c, f) for c, fs in ((1, "ab"), (2, "ab"), (3, "abc"), (4, "c")) for f in fs]
    got = {(r.file_a, r.file_b): (r.co_changes, r.strength) for r in graph.coupling(spark.createDataFrame(rows, "commit_id long, file string"), 1).collect()}
    assert got["a", "b"] == (3, 1.0) and got["a", "c"] == (1, pytest.approx(1 / 3))


def test_lexical_ladder(spark):
    names = ["rename_symbol", "rename symbol", "x_rename_symbol_y", "symbol_table", "other"]
    docs = spark.createDataFrame([(i, n, "sig", "p/" + n, "src/f.rs", "variable") for i, n in enumerate(names)],
                                 "id long, name string, signature string, name_path string, file_path string, kind string")
    got = {r.id: r.score for r in rank.lexical(docs, spark.createDataFrame([("q", "rename symbol")], "query_id string, query string")).collect()}
    assert (got[0], got[1], got[2]) == (80, 100, 65) and got[3] == 35 and 4 not in got


def test_bm25_prefers_names_and_handles_nothing(spark):
    schema = "id long, name string, signature string, name_path string, file_path string"
    docs = spark.createDataFrame([(1, "alpha", "fn alpha()", "m/alpha", "a.rs"), (2, "beta", "fn beta(alpha)", "m/beta", "b.rs"), (3, "c", "x", "y", "z")], schema)
    q = spark.createDataFrame([("q", "alpha"), ("none", "zzz")], "query_id string, query string")
    got = [(r.query_id, r.id) for r in rank.bm25(docs, q).orderBy("query_id", "rank").collect()]
    assert got == [("q", 1), ("q", 2)]
    assert rank.bm25(docs.limit(0), q).count() == 0


def test_rrf_and_budget_and_diversity(spark):
    lane = lambda *keys: spark.createDataFrame([("q", k, i + 1) for i, k in enumerate(keys)], "query_id string, key string, rank int")
    asked = spark.createDataFrame([("q", "an")], "query_id string, query string")
    lanes = {"structural": lane("A", "B"), "semantic": lane("B", "C"), "sparse": lane("C")}
    got = rank.fuse(lanes, asked).orderBy("rank").collect()
    assert [r.key for r in got] == ["B", "C", "A"] and got[0].relevance == 100 and got[-1].relevance == 1
    capped = rank.fuse({"sparse": lane(*"ABCDEFG"), "semantic": lane(*"abcdefg")}, asked)
    assert {r.key for r in capped.collect()} == set("ABabc")
    with_files = {r.key: r.rrf for r in rank.fuse(lanes, asked, lane("A", "Z")).collect()}
    assert with_files == {"A": pytest.approx(1.6 / 61), "B": pytest.approx(1 / 62 + 1 / 61), "C": pytest.approx(1 / 62 + 0.8 / 61)}
    ev = {r.key: (r.selected, r.final_rank) for r in rank.evidence(lane("B", "x"), rank.fuse(lanes, asked)).collect()}
    assert ev == {"B": (True, 1), "x": (False, None)}
    rows = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate((300, 150, 100))], "query_id string, rank int, size int")
    assert [r.rank for r in rank.budget(rows, "size", 400).collect()] == [1]
    rows = spark.createDataFrame([("q", i, "f" if i < 5 else f"g{i}", 10 - i) for i in range(7)], "query_id string, id int, file_path string, score int")
    assert [r.id for r in rank.diverse(rows, 5).orderBy("rank").collect()] == [0, 1, 2, 5, 6]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, "f", [1.0, 0.0]), (2, "f", [0.9, 0.1]), (3, "f", [0.0, 1.0]), (4, "g", [1.0, 0.1])], "id long, file_path string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    assert [r.id for r in vector.knn(rows, q, 2).orderBy("rank").collect()] == [1, 4]
    assert vector.knn(rows, q, 1, "l2").first().score == 1.0
    assert vector.misplaced(rows, 1).first().id == 3
    pairs = vector.duplicate_pairs(rows, 0.9, 10).collect()
    assert {(r.a, r.b) for r in pairs} == {(1, 2), (1, 4), (2, 4)}
    with pytest.raises(ValueError):
        vector.MAX_QUERIES, keep = 0, vector.MAX_QUERIES
        try:
            vector.knn(rows, q)
        finally:
            vector.MAX_QUERIES = keep


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id long, session string, tool string, elapsed_ms double, ms long, args string").withColumn("ts", F.timestamp_millis("ms"))


def test_percentiles_differ_by_definition(spark):
    for n, a, b in ((100, 95, 95), (21, 20, 20), (10, 9, 10)):
        r = telemetry.p95(calls(spark, [(i, "s", "t", float(i), i, "") for i in range(1, n + 1)])).first()
        assert (r.p95_ring, r.p95_harness) == (a, b)


def test_rate_limit_counts_earlier_calls(spark):
    rows = [(i, "s", "t", 0.0, i * 10, "") for i in range(303)] + [(303, "s", "t", 0.0, 3020 + 61_000, "")]
    got = {r.call_id: r.rejected for r in telemetry.rate_limited(calls(spark, rows)).collect()}
    assert not any(got[i] for i in range(301)) and got[301] and got[302] and not got[303]


def test_loops_transitions_and_claims(spark):
    rows = [(i, "s", t, 0.0, i, a) for i, (t, a) in enumerate([("x", "1")] * 3 + [("x", "2")] + [("y", "1")] * 4)]
    assert sorted((r.tool, r.length) for r in telemetry.doom_loops(calls(spark, rows)).collect()) == [("x", 3), ("y", 4)]
    ev = spark.createDataFrame([("j", 1, 1, "queued"), ("j", 2, 2, "running"), ("j", 3, 3, "queued")], "job string, at int, seq int, state string")
    assert [r.state for r in telemetry.invalid_transitions(ev).collect()] == ["queued"] and telemetry.latest(ev).first().state == "queued"
    claims = spark.createDataFrame([("a", ["p", "q"], 9), ("b", ["q"], 9), ("c", ["q"], 1)], "session_id string, paths array<string>, expires_at int")
    assert [tuple(r) for r in telemetry.overlapping_claims(claims, 5).collect()] == [("a", "b", 1)]


def test_lookups(spark):
    files = spark.createDataFrame([(1, "src/a.rs", "one\nTODO: fix NOTE\nthe end", 10), (2, "lib/b/c.py", "x", 5)], "id long, relative_path string, content string, size_bytes long")
    assert {(r.tag, r.message) for r in lookup.annotations(files).collect()} == {("TODO", "fix NOTE"), ("NOTE", "")}
    assert {(r.name, r.kind) for r in lookup.list_dir(files, "lib").collect()} == {("b", "dir")}
    assert [r.id for r in lookup.find_files(files, "*.py").collect()] == [2]
    r = lookup.grep(files, "T.DO").first()
    assert (r.line_no, r.column, r.context) == (2, 1, "one\nTODO: fix NOTE\nthe end")
    spans = spark.createDataFrame([("f", 1, 1, 50), ("f", 2, 10, 20), ("f", 3, 15, 90)], "file_path string, span_id long, start long, stop long")
    points = spark.createDataFrame([(1, "f", 12), (2, "f", 60), (3, "f", 99)], "point_id long, file_path string, at long")
    assert {r.point_id: r.span_id for r in lookup.enclosing(points, spans).collect()} == {1: 2, 2: 3, 3: None}


def test_evaluation_and_edits(spark):
    keys = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    r = evaluation.prf(keys("a", "b", "c"), keys("b", "c", "d", "e"), ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 2) and r.f == pytest.approx(4 / 7, abs=1e-6)
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(14)))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "x " + " ".join(f"W{i}," for i in range(13)) + " y"), (8, "w1 w2")], "doc_id long, text string")
    assert [tuple(r) for r in evaluation.contamination(items, docs).collect()] == [(1, 1)]
    files = spark.createDataFrame([(1, "foo food\nfoo()")], "id long, content string")
    assert [(r.line_no, r.after) for r in edits.rename(files, "foo", "bar").orderBy("line_no").collect()] == [(1, "bar food"), (2, "bar()")]
    assert [r.after for r in edits.rename(files, "food", "$x\\1").collect()] == ["foo $x\\1"] and edits.rename(files, "f.o", "y").count() == 0


def test_type_hierarchy(spark):
    s = spark.createDataFrame([("B", "A"), ("C", "B")], "name string, supertype string")
    roots = spark.createDataFrame([("A",)], "root string")
    assert {(r.node, r.depth) for r in types.hierarchy(s, roots).collect()} == {("B", 1), ("C", 2)}
    assert types.hierarchy(s, roots, down=False).count() == 0


def test_name_paths_of_any_depth(spark):
    n = 300
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(1000, 999)], "id long, parent_id long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(n)] + [(1000, "orphan")], "id long, name string")
    got = {r.id: r.name_path for r in lookup.name_paths(tree, names).collect()}
    assert got[n - 1] == "/".join(f"n{i}" for i in range(n)) and got[0] == "n0" and got[1000] == "orphan" and len(got) == n + 1
    loop = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long")
    with pytest.raises(ValueError):
        lookup.name_paths(loop, names, max_rounds=4)


def test_prefix_ranges(spark):
    rows = spark.createDataFrame([(p,) for p in ("a", "ab", "b", "a\U0010ffff", "a\U0010ffffz", "a\ud7ff", "a\ue000")], "file_path string")
    found = lambda p: {r.file_path for r in lookup.prefix_range(rows, p).collect()}
    assert found("") == {r.file_path for r in rows.collect()} and found("ab") == {"ab"}
    assert found("a\U0010ffff") == {"a\U0010ffff", "a\U0010ffffz"} and found("a\ud7ff") == {"a\ud7ff"}


def test_duplicates_are_found_across_files_and_in_large_codes(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base, base + 0.02 * rng.standard_normal((30, 16)), np.tile(base[:1], (20, 1))]).astype("float32")
    rows = spark.createDataFrame([(i, f"f{i}.rs", v) for i, v in enumerate(x.tolist())] + [(900, "n.rs", None), (901, "z.rs", [0.0] * 16)],
                                 "id long, file_path string, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if unit[i].astype(float) @ unit[j] >= 0.95}
    assert {(r.a, r.b) for r in vector.duplicate_pairs(rows, 0.95, 1000, recall=0.9999).collect()} == want
    assert len(want) > 200


def test_duplicate_noise(spark):
    rows = spark.createDataFrame(
        [("a.yml", "b.yml", "x", "x", "function", "function", 0.99, 1.0), ("a.yml", "b.rs", "runs-on", "f", "function", "function", 0.99, 1.0),
         ("a.rs", "a.rs", "f", "f", "function", "function", 0.99, 1.0), ("a.rs", "a.rs", "p", "q", "const", "field", 0.99, 1.0),
         ("a.rs", "b.rs", "f", "g", "function", "function", 0.9, 0.4), ("a.rs", "b.rs", "f", "g", "function", "function", 0.8, 0.4),
         ("a.yml", "b.rs", "parse", "f", "function", "function", 0.99, 1.0)],
        "file_a string, file_b string, name_a string, name_b string, kind_a string, kind_b string, similarity double, jaccard double",
    )
    got = [r.n for r in rows.select(vector.noise().alias("n")).collect()]
    assert got == ["config_config", "config_code", "same_symbol", "same_file_data", "signature_only", "kept", "kept"]


def test_notes_agents_and_claims(spark):
    notes = spark.createDataFrame([("a", "---\nk: v\n---\nbody", False), ("policy", "rules", True)], "note string, text string, archived boolean")
    assert notebook.read(notes, "a").first().body == "body" and notebook.policy(notes).first().body == "rules"
    aged = notes.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    now = F.lit("2024-01-16").cast("timestamp")
    assert [r.note for r in notebook.listed(aged, now).where("stale").collect()] == ["a"]
    assert [r.note for r in notebook.listed(aged, now, archived=True).collect()] == ["policy"]
    agents = spark.createDataFrame([("s", 1), ("t", 2)], "session string, expires_at int")
    new = spark.createDataFrame([("s", 9)], "session string, expires_at int")
    assert {tuple(r) for r in notebook.register(agents, new).collect()} == {("s", 9), ("t", 2)}
    claims = spark.createDataFrame([("s", ["p"])], "session string, paths array<string>")
    more = notebook.claim(notebook.claim(claims, "s", ["q", "p"]), "t", ["p"])
    assert {(r.session, tuple(r.paths)) for r in more.collect()} == {("s", ("p", "q")), ("t", ("p",))}
    assert {(r.session, tuple(r.paths)) for r in notebook.release(more, "t", ["p"]).collect()} == {("s", ("p", "q"))}
