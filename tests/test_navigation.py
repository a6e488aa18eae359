import pytest
from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import navigation
from quarry.sources import scip


def occ(symbol, start, roles=0, end=None, docs=(), diagnostics=()):
    (line, a, b), last = start, end if end is not None else start[0]
    return {"symbol": symbol, "start_line": line, "start_col": a, "end_line": last, "end_col": b, "roles": roles, "docs": list(docs), "diagnostics": list(diagnostics)}


def doc(path, occurrences, symbols=(), language="rust"):
    return {"path": path, "language": language, "occurrences": occurrences, "symbols": [{"symbol": s, "docs": list(d), "display_name": ""} for s, d in symbols]}


RUN, NEW, TYPE, EXT = "r c p 1 src/a.rs/run().", "r c p 1 src/b.rs/forge().", "r c p 1 src/b.rs/Thing#", "r c std 1 io/print()."
DOCS = [
    doc("src/a.rs", [occ(RUN, (2, 3, 6), 1), occ(NEW, (4, 8, 12)), occ(EXT, (5, 0, 5), 8), occ(RUN, (6, 0, 3)),
                     occ("r c p 1 src/a.rs/late().", (300, 3, 7), 1), occ(NEW, (301, 1, 5), docs=["made", "here"])], [(RUN, ["Runs.", "Fast."])]),
    doc("src/b.rs", [occ(TYPE, (0, 0, 5), 1), occ(NEW, (0, 9, 13), 1, end=3), occ("r c p 1 src/b.rs/Thing#é().", (9, 0, 2), 1, diagnostics=[{"severity": 2, "code": "W1", "message": "no ☃"}, {"severity": 0, "code": "", "message": ""}])],
        [(TYPE, []), (NEW, ["Makes."])]),
    doc("empty.rs", []),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([*DOCS, {"path": None, "language": None, "occurrences": [], "symbols": [{"symbol": EXT, "docs": ["Prints."], "display_name": "print"}]}], scip.DOCUMENT)
    folder = storage.new_folder(spark, "test-index")
    assert scip.write(rows, folder) == 4
    docs = scip.read(spark, folder).cache()
    return docs, scip.occurrences(docs), scip.symbols(docs)


def test_documents_come_back_whole(spark, index):
    got = {r.path: r.asDict(recursive=True) for r in index[0].collect()}
    assert set(got) == {"src/a.rs", "src/b.rs", "empty.rs", None}
    for d in DOCS:
        assert got[d["path"]] == d
    assert got[None]["symbols"] == [{"symbol": EXT, "docs": ["Prints."], "display_name": "print"}]


def test_fields_of_other_writers_are_passed_over_and_ranges_need_not_be_packed(spark, tmp_path):
    unpacked = b"".join(scip._put(scip.OCC_RANGE, x) for x in (7, 1, 9)) + scip._put(scip.OCC_SYMBOL, "x/y().") + b"\x5d\x01\x02\x03\x04"
    body = scip._put(scip.DOC_PATH, "p") + scip._put(scip.DOC_OCCURRENCES, unpacked) + scip._put(5, "text" * 1000)
    big = scip._put(scip.DOC_PATH, "q") + scip._put(5, b"z" * (3 * scip.WINDOW))
    data = scip._put(1, b"meta") + scip._put(scip.INDEX_DOCUMENT, big) + b"\x28\x07" + b"\x31" + b"\0" * 8 + scip._put(scip.INDEX_DOCUMENT, body)
    (tmp_path / "a.scip").write_bytes(data)
    (tmp_path / "none.scip").write_bytes(b"")
    rows = {r.path: r for r in scip.read(spark, f"file://{tmp_path}").collect()}
    o = rows["p"].occurrences[0]
    assert set(rows) == {"p", "q"} and (o.start_line, o.start_col, o.end_line, o.end_col, o.symbol) == (7, 1, 7, 9, "x/y().")
    (tmp_path / "cut.scip").write_bytes(data[:-5])
    with pytest.raises(Exception, match="no whole index file"):
        scip.read(spark, f"file://{tmp_path}").count()


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, name string, file string, line int")


def test_definitions_and_references(spark, index):
    _, o, known = index
    q = asked(spark, ("place", "forge", "src/a.rs", 4), ("file", "forge", "src/a.rs", 99), ("all", "Thing", "x", 0), ("fall", "late", "x", 0), ("none", "zzz", "x", 0))
    got = {(r.query_id, r.symbol, r.file, r.line, r.end_line, r.score) for r in navigation.definitions(o, known, q).collect()}
    assert got == {
        ("place", NEW, "src/b.rs", 0, 8, 1.0), ("file", NEW, "src/b.rs", 0, 8, 1.0), ("all", TYPE, "src/b.rs", 0, 8, 1.0),
        ("fall", "r c p 1 src/a.rs/late().", "src/a.rs", 300, None, 0.9),
    }
    refs = {(r.query_id, r.file, r.line, r.kind, r.score) for r in navigation.references(o, known, q.where("query_id in ('place', 'fall')")).collect()}
    assert refs == {("place", "src/b.rs", 0, "definition", 1.0), ("place", "src/a.rs", 4, "reference", 0.8), ("place", "src/a.rs", 301, "reference", 0.8),
                    ("fall", "src/a.rs", 300, "reference", 0.7)}


def test_hover_and_diagnostics(spark, index):
    _, o, known = index
    points = [("sym", "src/a.rs", 2, 4), ("own", "src/a.rs", 301, 1), ("ext", "src/a.rs", 5, 0), ("bare", "src/b.rs", 0, 0), ("end", "src/a.rs", 2, 6), ("span", "src/b.rs", 3, 10)]
    got = {r.query_id: r.text for r in navigation.hover(o, known, spark.createDataFrame(points, "query_id string, file string, line int, col int")).collect()}
    assert got == {"sym": "Runs.\nFast.", "own": "made\nhere", "ext": "Prints.", "bare": TYPE, "span": "Makes."}
    assert {tuple(r) for r in navigation.diagnostics(o).collect()} == {("src/b.rs", 9, 0, "warning", "W1", "no ☃"), ("src/b.rs", 9, 0, "warning", None, "")}


def test_callers_and_callees(spark, index):
    _, o, known = index
    q = spark.createDataFrame([("q", "run", "src/a.rs"), ("l", "late", "src/a.rs"), ("x", "zzz", "src/a.rs")], "query_id string, function string, file string")
    got = {tuple(r) for r in navigation.callees(o, q).select("query_id", "name", "line", "resolved_file").collect()}
    assert got == {("q", "forge", 4, "src/b.rs"), ("l", "forge", 301, "src/b.rs")}  # print is noise, and run calls itself
    c = spark.createDataFrame([("m", "forge"), ("t", "Thing"), ("r", "run")], "query_id string, name string")
    assert {tuple(r) for r in navigation.callers(o, known, c).collect()} == {("m", "src/a.rs", "run", 4), ("m", "src/a.rs", "late", 301)}


def test_short_names(spark):
    texts = {RUN: "run", TYPE: "Thing", "local 3": "local 3", "a/b#c.d().": "d", "": "", "x/`Bär`#é().": "é"}
    rows = spark.createDataFrame([(k,) for k in texts], "s string").select("s", navigation.short_name(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in rows} == texts
