"""Reports, edit plans and embedding texts over small projects."""

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import edits, reports


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_boundary_sections(spark):
    edges = frame(spark, "src string, dst string", ("a", "f"), ("b", "a"), ("c", "b"), ("f", "g"), ("g", "f"))
    symbols = frame(spark, "file string", ("a",), ("a",), ("g",))
    commits = frame(spark, "commit_id long, file string", *[(i, x) for i in range(4) for x in "fk"], (9, "f"), (9, "a"))
    alike = frame(spark, "file string, other string, score double", ("f", "z", 0.5), ("f", "f", 1.0), ("f", "y", 0.1))
    got = sorted(tuple(r) for r in reports.boundary(edges, symbols, commits, alike, frame(spark, "root string", ("f",))).collect())
    assert got == [("affected", "a", 1.0), ("affected", "b", 2.0), ("affected", "g", 1.0), ("alike", "z", 0.5), ("coupled", "k", 0.8), ("cycle", "g", 1.0)]


def test_importers_and_impact(spark):
    edges = frame(spark, "src string, dst string", *[(f"i{n:02}", "f") for n in range(25)], ("x", "g"), ("y", "x"))
    roots = frame(spark, "root string", ("f",), ("g",))
    got = reports.importers(edges, roots).collect()
    assert sum(r.root == "f" for r in got) == 20 and all(r.limit_hit == (r.root == "f") for r in got) and ("g", "x", False) in [tuple(r) for r in got]
    symbols = frame(spark, "file string", ("x",), ("x",))
    far = {(r.file, r.depth, r.symbol_count) for r in reports.impact(edges, symbols, roots).collect() if r.root == "g"}
    assert far == {("x", 1, 2), ("y", 2, 0)}


def test_renames_readiness_and_requests(spark):
    symbols = frame(spark, "name string, file_path string", ("a", "1"), ("b", "1"), ("c", "2"), ("c", "3"), ("d", "4"))
    calls = frame(spark, "callee_name string", ("d",), ("d",))
    asked = frame(spark, "name string, new_name string", ("a", "b"), ("c", "x"), ("d", "x"), ("ghost", "x"))
    got = {r.name: (r.definitions, r.references, r.collisions, r.status) for r in reports.safe_rename(symbols, calls, asked).collect()}
    assert got == {"a": (1, 0, 1, "blocked"), "c": (2, 0, 0, "caution"), "d": (1, 2, 0, "ready"), "ghost": (0, 0, 0, "blocked")}
    subject = lambda *x: frame(spark, "subject string", *[(v,) for v in x])
    ready = reports.readiness(subject("p", "q", "r"), subject("p", "q", "r", "r"), subject(*["q"] * 101), subject("p", "q"))
    assert {r.subject: (r.diagnostics, r.refs, r.tests, r.mutation) for r in ready.collect()} == {
        "p": ("ready", "ready", "ready", "ready"), "q": ("ready", "blocked", "ready", "blocked"), "r": ("caution", "ready", "caution", "caution"),
    }
    ranked = frame(spark, "query_id string, id long, rank long", ("q", 1, 1), ("q", 2, 2), ("q", 3, 3))
    docs = frame(spark, "id long, file_path string", (1, "a.rs"), (2, "tests/b.rs"), (3, "c.rs"))
    got = [(r.file_path, r.changed) for r in reports.change_request(ranked, docs, frame(spark, "file_path string", ("c.rs",))).orderBy("rank").collect()]
    assert got == [("c.rs", True), ("a.rs", False)]


def test_expansion(spark):
    q = frame(spark, "query_id string, query string", ("1", "rename the symbol"), ("2", "get_user_id"), ("3", "getUser"), ("4", "x"), ("5", "do it"))
    got = {}
    for r in reports.expanded(q, [(("rename", "symbol"), ("alias",))]).collect():
        got.setdefault(r.query_id, set()).add(r.term)
    assert got["1"] == {"rename the symbol", "rename_the", "the_symbol", "rename_the_symbol", "renameTheSymbol", "RenameTheSymbol", "alias"}
    assert got["2"] == {"get_user_id", "getUserId"} and got["3"] == {"getUser", "get_user"} and got["4"] == {"x"} and got["5"] == {"do it"}


def test_embedding_texts_and_leading_docs(spark):
    rows = frame(spark, "k string, n string, np string, p string, s string", ("method", "getUser", "Svc/getUser", "a/users/api.rs", "fn getUser()"), ("class", "C", "C", "src/c.py", ""), ("class", "C", "C", "", ""))
    c = F.col
    got = [r[0] for r in rows.select(T.embedding_text(c("k"), c("n"), c("np"), c("p"), c("s"))).collect()]
    assert got == ["method getUser (get User) (in Svc) [users] in api.rs: fn getUser()", "class C in c.py", "class C"]
    text = frame(spark, "t string, n int", ("x\n/// one\n// two\nfn f()", 4), ("# a\n\ndef f()", 3), ("def f()", 1))
    assert [r[0] for r in text.select(T.leading_doc(F.split("t", "\n"), c("n"))).collect()] == ["one two", "", ""]


def test_edit_plans(spark):
    files = frame(spark, "id long, relative_path string, content string", (1, "a.py", "x\n  if y:\n    z\nw"), (2, "b.rs", "let a;\nfoo(1);"), (3, "c.txt", "q"))
    spans = frame(spark, "id long, start long, stop long, name string", (1, 2, 3, "part"), (2, 1, 2, "p"), (3, 1, 1, "p"), (2, 2, 9, "p"), (1, 0, 1, "p"))
    got = [tuple(r) for r in edits.extract(files, spans).collect()]
    assert (1, True, "def part():\n    if y:\n      z\n", "  part()") in got and (2, True, "fn p() {\n    let a;\n    foo(1);\n}\n", "p();") in got
    assert sorted(r[0] for r in got if not r[1]) == [1, 2, 3] and all(r[2] is None for r in got if not r[1])
    code = frame(spark, "id long, content string", (1, "fn f(a) { g(a) }\nf(2); off(1)\nh(f(3))"))
    wrappers = frame(spark, "id long, line_no long, name string, target string", (1, 1, "f", "g"))
    assert sorted(tuple(r) for r in edits.inline(code, wrappers).collect()) == [(1, 1, "remove", ""), (1, 2, "replace", "g(2); off(1)"), (1, 3, "replace", "h(g(3))")]
    new = sorted(tuple(r) for r in edits.change_signature(code, "f", "a, $b").collect())
    assert new == [(1, 1, "replace", "fn f(a, $b) { g(a) }"), (1, 2, "review", "f(2); off(1)"), (1, 3, "review", "h(f(3))")]
