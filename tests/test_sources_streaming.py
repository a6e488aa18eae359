import json

from pyspark.sql import functions as F

from quarry.operators import telemetry
from quarry.sources import buckets, code, git
from quarry.streaming import ingest

SOURCE = '''import os
from a.b import c

class Service:
    def run(self):
        return helper(os.getcwd())

def helper(x):
    return c(x)
'''


def test_project_files_and_python_symbols(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/s.py").write_text(SOURCE)
    (tmp_path / "pkg/bad.py").write_text("def (")
    (tmp_path / "node_modules/x.py").write_text("y = 1")
    files = code.project_files(spark, f"file://{tmp_path}")
    assert sorted(r.relative_path for r in files.collect()) == ["pkg/bad.py", "pkg/s.py"]
    rows = code.parse_python(files).collect()
    assert {(r.kind, r.name_path) for r in rows if r.row == "symbol"} == {("class", "Service"), ("method", "Service/run"), ("function", "helper")}
    assert {(r.name_path, r.name) for r in rows if r.row == "call"} == {("Service/run", "helper"), ("Service/run", "getcwd"), ("helper", "c")}
    assert {r.name for r in rows if r.row == "import"} == {"os", "a.b"}


def test_walk_leaves_out_what_is_excluded_and_nothing_else(spark, tmp_path):
    root = tmp_path / "build"  # only what lies below the root decides
    keep = ["a.py", "src/big.rs", "environment/x.go", "docs/out.md", "src/min.js", "backups/b.py"]
    gone = [".venv-x/a.py", "venv/a.py", "backup-1/a.py", ".next/a.js", "w/.worktrees/x/a.py", ".tox/a.py", "x/out/a.rs", "a.min.js", "yarn.lock", "x.gen.ts", "own/a.py"]
    for name in keep + gone:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    (root / "src/big.rs").write_text("fn a() { b() }\n" * (11 << 16))  # 11 MB
    files = code.project_files(spark, f"file://{root}", more=("own/*",))
    got = {r.relative_path: r.size_bytes for r in files.select("relative_path", "size_bytes").collect()}
    assert sorted(got) == sorted(keep) and got["src/big.rs"] > 10 << 20


def test_deep_expressions_parse_or_say_why_not(spark):
    texts = ["x = " + "+".join(["f(1)"] * 5000), "a" + ".b" * 5000, "(" * 3000 + ")" * 3000, "def ok(): g()", "def (", "\0"]
    files = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(texts)], "relative_path string, content string")
    rows = code.parse_python(files).collect()
    per = {i: [(r.row, r.name) for r in rows if r.file_path == f"{i}.py"] for i in range(len(texts))}
    assert per[0] == [("call", "f")] * 5000 or [r for r, _ in per[0]] == ["error"]
    assert per[1] in ([], [("error", "RecursionError")]) and [r for r, _ in per[2]] == ["error"]
    assert per[3] == [("symbol", "ok"), ("call", "g")] and per[4] == [("error", "SyntaxError")] and [r for r, _ in per[5]] == ["error"]
    assert code.scoped_references(files).where("file_path = '3.py'").count() == 2


def test_sources_of_other_languages(spark):
    files = spark.createDataFrame([("a.rs", "impl A {\n  fn run(&self) { go(1) }\n}"), ("b.ts", "class B { x() { y(); } }"), ("c.txt", "fn no() {}")], "relative_path string, content string")
    rows = code.parse_sources(files).collect()
    assert {(r.file_path, r.name_path, r.signature) for r in rows if r.row == "symbol"} == {("a.rs", "A/run", "fn run(&self) { go(1) }"), ("b.ts", "B", "class B { x() { y(); } }"), ("b.ts", "B/x", "class B { x() { y(); } }")}
    assert {(r.name_path, r.name) for r in rows if r.row == "call"} == {("A/run", "go"), ("B/x", "y")}


def test_event_stream_keeps_the_newest_row_of_each_path(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(n, *events):
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("batch", "path", "kind", "at"), e, strict=True))) for e in events))

    put(1, (1, "a", "created", "2024-01-01 00:00:00"), (1, "a", "modified", "2024-01-01 00:00:01"), (1, "b", "created", "2024-01-01 00:00:00"))
    run = lambda: ingest.upsert_stream(ingest.file_events(spark, str(src)), f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination()
    run()
    put(2, (2, "b", "deleted", "2024-01-02 00:00:00"), (2, "c", "created", "2024-01-02 00:00:00"))
    run()
    got = buckets.latest(spark, f"{tmp_path}/out").collect()
    assert {(r.path, r.kind) for r in got} == {("a", "modified"), ("c", "created")}


def test_buckets_keep_the_last_version_of_each(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long, deleted boolean")
    folder = f"{tmp_path}/t"
    assert buckets.latest(spark, folder) is None
    buckets.merge(rows(*[(f"k{i}", i, False) for i in range(50)], ("k1", 100, False)), folder, "k", 0, 8)
    buckets.merge(rows(("k1", 7, False), ("k2", 0, True), ("new", 9, False)), folder, "k", 1, 8)
    want = {(f"k{i}", i) for i in range(50) if i not in (1, 2)} | {("k1", 7), ("new", 9)}
    read = lambda: {tuple(r) for r in buckets.latest(spark, folder).select("k", "n").collect()}
    assert read() == want
    buckets.merge(rows(("k1", 7, False), ("k2", 0, True), ("new", 9, False)), folder, "k", 1, 8)  # a retried batch
    assert read() == want
    buckets.merge(rows(*[(k, None, True) for k, _ in want]), folder, "k", 2, 8)
    buckets.merge(rows(), folder, "k", 3, 8)
    assert read() == set()
    touched = spark.read.parquet(folder).where("v = 1").select("bucket").distinct().count()
    assert touched <= 3


def test_refresh_parses_changed_files_only(spark, tmp_path):
    root, index = tmp_path / "p", f"{tmp_path}/index"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/a.py").write_text("def one():\n    two()\n")
    (root / "b.py").write_text("import os\nclass B:\n    def m(self): pass\n")
    symbols = lambda: {(r.file_path, r.name) for r in buckets.latest(spark, f"{index}/rows").where("row = 'symbol'").collect()}
    assert code.refresh(spark, f"file://{root}", index, 0) == {"changed": 2, "gone": 0}
    assert symbols() == {("pkg/a.py", "one"), ("b.py", "B"), ("b.py", "m")}
    (root / "pkg/a.py").write_text("def three(): pass\n")
    (root / "b.py").unlink()
    (root / "c.txt").write_text("no code")
    assert code.refresh(spark, f"file://{root}", index, 1) == {"changed": 2, "gone": 1}
    assert symbols() == {("pkg/a.py", "three")}
    assert {r.relative_path for r in buckets.latest(spark, f"{index}/files").collect()} == {"pkg/a.py", "c.txt"}
    assert code.refresh(spark, f"file://{root}", index, 2) == {"changed": 0, "gone": 0} and symbols() == {("pkg/a.py", "three")}


def test_leases_are_renewed_in_time(spark, tmp_path):
    spark.createDataFrame([("s", t) for t in (100, 150, 230, 400, 420)] + [("t", 5)], "session string, ms long").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, ms long").json(f"{tmp_path}/in")
    q = ingest.leases(stream, 100).writeStream.format("memory").queryName("leased").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    got = {(r.session, r.ms): (r.taken_at, r.expires_at) for r in spark.table("leased").where("not expired").collect()}
    assert got == {("s", 100): (100, 200), ("s", 150): (100, 250), ("s", 230): (100, 330), ("s", 400): (400, 500), ("s", 420): (400, 520), ("t", 5): (5, 105)}


def test_leases_expire_without_input_of_their_own(spark, tmp_path):
    heart = lambda n, *x: spark.createDataFrame(list(x), "session string, ms long").coalesce(1).write.json(f"{tmp_path}/in/{n}")
    out = f"{tmp_path}/out"

    def run():
        stream = spark.readStream.schema("session string, ms long").option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        q = ingest.leases(stream, 1000, "1 second").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        q = q.outputMode("append").trigger(availableNow=True).start(out)
        q.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return {tuple(r) for r in spark.read.parquet(out).where("expired").select("session", "ms", "taken_at", "expires_at").collect()}, held[-1]

    heart(1, ("a", 10_000), ("a", 10_500), ("b", 10_200))
    assert run() == (set(), 2)
    heart(2, ("b", 11_100), ("c", 12_600))  # the watermark is at 11,600: a has run out at 11,500
    assert run() == ({("a", 10_500, 10_000, 11_500)}, 2)
    heart(3, ("c", 13_500), ("a", 13_400))  # from the checkpoint: b has run out at 12,100, and a takes a new lease
    assert run() == ({("a", 10_500, 10_000, 11_500), ("b", 11_100, 10_200, 12_100)}, 2)


def test_limits_forget_idle_sessions(spark, tmp_path):
    rows = [("idle", i, 1000 + i) for i in range(4)] + [("busy", 10, 1500)]
    spark.createDataFrame(rows, "session string, call_id long, ms long").coalesce(1).write.json(f"{tmp_path}/in/1")

    def run():
        stream = spark.readStream.schema("session string, call_id long, ms long").option("recursiveFileLookup", True).json(f"{tmp_path}/in")
        q = ingest.rate_limit(stream, 2, 1000, "1 second").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        q = q.outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    assert run() == 2
    spark.createDataFrame([("busy", 11, 9000)], "session string, call_id long, ms long").write.json(f"{tmp_path}/in/2")
    assert run() == 1
    assert {r.call_id for r in spark.read.parquet(f"{tmp_path}/out").where("rejected").collect()} == {3}


def test_events_of_one_instant_have_an_order(spark, tmp_path):
    from quarry.sources import buckets

    rows = [(1, "x", "deleted", "2024-01-01 00:00:00"), (1, "x", "created", "2024-01-01 00:00:00"), (2, "y", "deleted", "2024-01-01 00:00:00"), (1, "y", "created", "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "batch long, path string, kind string, at string").withColumn("at", F.to_timestamp("at"))
    events.repartition(4).write.json(f"{tmp_path}/in")
    ingest.upsert_stream(ingest.file_events(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination()
    assert {(r.path, r.kind) for r in buckets.latest(spark, f"{tmp_path}/out").collect()} == {("x", "created")}


def test_stateful_rate_limit_equals_the_batch_one(spark, tmp_path):
    rows = [(f"s{i % 2}", i, i * 400) for i in range(120)]
    spark.createDataFrame(rows, "session string, call_id long, ms long").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, call_id long, ms long").json(f"{tmp_path}/in")
    q = ingest.rate_limit(stream, 5, 5000).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    got = {r.call_id: r.rejected for r in spark.table("limited").collect()}
    batch = spark.createDataFrame(rows, "session string, call_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert got == {r.call_id: r.rejected for r in telemetry.rate_limited(batch, 5, 5000).collect()} and any(got.values())


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("t", "2024-01-01 00:10:00"), ("t", "2024-01-01 00:50:00"), ("t", "2024-01-01 05:00:00")], "tool string, ts string").selectExpr(
        "tool", "cast(ts as timestamp) ts"
    ).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("tool string, ts timestamp").parquet(f"{tmp_path}/in")
    q = ingest.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True)
    q.option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    assert sorted(r.calls for r in spark.table("windows").collect()) == [1, 2]


def test_git_listings(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    named = git.name_status(lines("M\tsrc/main.py", "A\tnew.py", "D\told.py", "R100\ta.py\tb.py", "", "junk"))
    assert {tuple(r) for r in named.collect()} == {("src/main.py", "M"), ("new.py", "A"), ("old.py", "D"), ("b.py", "R")}
    short = git.porcelain(lines(" M src/main.py", "?? x.py", "A  y.py", "R  p.py -> q.py", '?? "sp ace.py"', ""))
    assert {tuple(r) for r in short.collect()} == {("src/main.py", "M"), ("x.py", "?"), ("y.py", "A"), ("q.py", "R"), ("sp ace.py", "?")}
    both = git.changed([named, short])
    assert dict(tuple(r) for r in both.collect())["src/main.py"] == "M" and both.count() == 8
    log = spark.createDataFrame([("commit\tabc\tann\t17\na.py\nb.py\n\ncommit\tdef\tbob\t18\n\n",), ("",)], "text string")
    assert {tuple(r) for r in git.commit_log(log).collect()} == {("abc", "ann", 17, "a.py"), ("abc", "ann", 17, "b.py")}
