"""The call cascade: stage by stage, and against plain loops over random projects."""

import random

import pytest

from quarry.operators import calls

SYMBOLS = "name string, kind string, file_path string, name_path string"
CALLS = "call_id long, caller_file string, caller_name string, caller_path string, callee_name string, qualifier string"


def tables(spark, symbols, sites, imports=(), bindings=()):
    return (
        spark.createDataFrame(sites, CALLS),
        spark.createDataFrame(symbols, SYMBOLS),
        spark.createDataFrame(list(imports), "src string, dst string"),
        spark.createDataFrame(list(bindings), calls.BINDINGS),
    )


def resolved(spark, *args):
    return {r.call_id: (r.strategy, r.resolved_file, r.canonical_name) for r in calls.resolve(*tables(spark, *args)).collect()}


def f(name, file, kind="function", owner=""):
    return (name, kind, file, f"{owner}/{name}" if owner else name)


def call(i, file, name, qualifier=None, path="run"):
    return (i, file, "run", path, name, qualifier)


def test_stages_in_order(spark):
    symbols = [f("f", "a/x.rs"), f("f", "b/y.rs"), f("g", "b/y.rs"), f("h", "a/z.rs"), f("h", "c/z.rs"), f("i", "c/p.rs"), f("i", "d/p.rs"),
               f("u", "z/u.rs"), f("u", "z/u.py"), f("s", "src/lib/s.rs"), f("s", "w/s.rs")]
    sites = [call(1, "a/x.rs", "f"), call(2, "q/m.rs", "f"), call(3, "q/m.rs", "g"), call(4, "a/w.rs", "h"), call(5, "q/m.rs", "i"),
             call(6, "q/m.rs", "none"), call(7, "q/m.rs", "u"), call(8, "t/m.rs", "s"), call(9, "q/m.ts", "only")]
    got = resolved(spark, symbols + [f("only", "k/o.ts")], sites, [("q/m.rs", "b/y.rs"), ("t/m.rs", "lib/s.rs")])
    assert got == {
        1: ("same_file", "a/x.rs", "f"), 2: ("import_map", "b/y.rs", "f"), 3: ("import_map", "b/y.rs", "g"), 4: ("path_proximity", "a/z.rs", "h"),
        5: ("unresolved", None, None), 6: ("unresolved", None, None), 7: ("unique_name", "z/u.rs", "u"), 8: ("import_suffix", "src/lib/s.rs", "s"),
        9: ("path_proximity", "k/o.ts", "only"),
    }


def test_owners(spark):
    symbols = [f("new", "a/s.rs", "method", "Store"), f("new", "b/t.rs", "method", "Table"), f("put", "a/s.rs", "method", "Store"),
               f("dup", "a/s.rs", "method", "Store"), f("dup", "b/s.rs", "method", "Store")]
    sites = [call(1, "m.rs", "new", "db::Store<T>"), call(2, "m.rs", "put", "Self", "Store/run"), call(3, "m.rs", "dup", "Store"),
             call(4, "m.rs", "new", "module"), call(5, "m.py", "new", "Store"), call(6, "m.rs", "gone", "Store")]
    got = calls.resolve(*tables(spark, symbols, sites)).collect()
    assert {r.call_id: (r.strategy, r.confidence, r.declaration) for r in got} == {
        1: ("owner_qualified", 0.98, "Store/new"), 2: ("owner_qualified", 0.98, "Store/put"), 3: ("unresolved", 0.25, "Store/dup"),
        4: ("unresolved", 0.25, None), 5: ("unresolved", 0.25, None), 6: ("unresolved", 0.25, "Store/gone"),
    }


def test_bindings(spark):
    symbols = [f("real", "lib/impl.ts"), f("deep", "lib/deep.ts"), f("local", "app.ts"), f("real", "other.ts")]
    b = [
        ("app.ts", "alias", "real", "lib/impl.ts", False), ("app.ts", "ns", "*", "lib/impl.ts", False), ("app.ts", "barrel", "*", "lib/index.ts", False),
        ("lib/index.ts", "shown", "real", "lib/impl.ts", False), ("lib/index.ts", "*", "*", "lib/deep.ts", False), ("app.ts", "shown", "shown", "lib/index.ts", False),
        ("app.ts", "inner", "sub", "lib/index.ts", False), ("lib/index.ts", "sub", "*", "lib/deep.ts", False), ("app.ts", "react", "useState", None, True),
        ("app.ts", "again", "outer", "lib/index.ts", False), ("lib/index.ts", "outer", "x", None, True),
    ]
    sites = [call(1, "app.ts", "alias"), call(2, "app.ts", "real", "ns"), call(3, "app.ts", "shown", "barrel"), call(4, "app.ts", "deep", "barrel"),
             call(5, "app.ts", "shown"), call(6, "app.ts", "deep", "inner"), call(7, "app.ts", "local"), call(8, "app.ts", "react"),
             call(9, "app.ts", "again"), call(10, "app.ts", "x", "react")]
    got = resolved(spark, symbols, sites, (), b)
    assert got[1] == ("import_map", "lib/impl.ts", "real") and got[2] == ("import_map", "lib/impl.ts", "real")
    assert got[3] == ("import_reexport_map", "lib/impl.ts", "real") and got[4] == ("import_reexport_map", "lib/deep.ts", "deep")
    assert got[5] == ("import_reexport_map", "lib/impl.ts", "real") and got[6] == ("import_reexport_map", "lib/deep.ts", "deep")
    assert got[7] == ("same_file", "app.ts", "local")
    rows, *_ = tables(spark, symbols, sites, (), b)
    left = calls.drop_external(rows, spark.createDataFrame(b, calls.BINDINGS))
    assert sorted(r.call_id for r in left.collect()) == [1, 2, 3, 4, 5, 6, 7]


def brute(symbols, sites, imports, bindings):
    files = {}
    for name, kind, file, path in symbols:
        files.setdefault(name, []).append(file)
    bound = {(x[0], x[1]): x for x in bindings}
    lang = lambda p: p.rsplit(".", 1)[-1] if p.rsplit(".", 1)[-1] in calls.LANGUAGES else None
    has = lambda name, file: file in files.get(name, [])

    def again(file, name):
        b = bound.get((file, name)) or bound.get((file, "*"))
        if b and b[3]:
            to = name if b[2] in ("*", None) else b[2]
            return (b[3], to) if has(to, b[3]) else None

    def one(file, path, name, q):
        key = lambda raw: raw.rsplit("::", 1)[-1].strip().split("<")[0].strip()
        if q and file.endswith(".rs"):
            owner = key(q)
            owner = key(path.rsplit("/", 1)[0]) if owner == "Self" and "/" in path else owner if owner[:1].isupper() and owner != "Self" else None
            if owner:
                hit = [s for s in symbols if s[0] == name and s[1] == "method" and s[2].endswith(".rs") and "/" in s[3] and key(s[3].rsplit("/", 1)[0]) == owner]
                return ("owner_qualified", hit[0][2]) if len(hit) == 1 else ("unresolved", None)
        space = bound.get((file, q)) if q else None
        if not (space and space[2] == "*") and has(name, file):
            return "same_file", file
        if space and space[3]:
            if space[2] == "*":
                if has(name, space[3]):
                    return "import_map", space[3]
                if x := again(space[3], name):
                    return "import_reexport_map", x[0]
            elif space[2]:
                inner = bound.get((space[3], space[2]))
                if inner and inner[2] == "*" and inner[3]:
                    if has(name, inner[3]):
                        return "import_reexport_map", inner[3]
                    if x := again(inner[3], name):
                        return "import_reexport_map", x[0]
        b = bound.get((file, name))
        if b and b[3]:
            to = b[2] or name
            if has(to, b[3]):
                return "import_map", b[3]
            if x := again(b[3], to):
                return "import_reexport_map", x[0]
        mine = [d for s, d in imports if s == file]
        if hit := sorted(x for x in files.get(name, []) if x in mine):
            return "import_map", hit[0]
        if hit := sorted(x for x in files.get(name, []) if any(x.endswith("/" + d) or d.endswith("/" + x) for d in mine)):
            return "import_suffix", hit[0]
        same = [x for x in files.get(name, []) if lang(file) and lang(x) == lang(file)]
        if len(same) == 1:
            return ("path_proximity" if lang(file) in calls.BINDING_LANGUAGES and same[0] != file else "unique_name"), same[0]

        def shared(x):
            n = 0
            for p, q in zip(x.split("/")[:-1], file.split("/")[:-1]):
                if p != q:
                    break
                n += 1
            return n

        near = sorted((-shared(x), x) for x in same if shared(x))
        return ("path_proximity", near[0][1]) if near else ("unresolved", None)

    return {i: one(file, path, name, q) for i, file, _, path, name, q in sites}


@pytest.mark.parametrize("seed", [4, 5])
def test_random_projects_match_plain_loops(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    paths = [f"{a}/{b}/f{i}.{e}" for a in ("src", "lib") for b in "xy" for i in range(3) for e in ("rs", "ts", "py")] + ["root.rs", "root.ts"]
    owners = ["Alpha", "Beta"]
    symbols = []
    for _ in range(70):
        kind = rnd.choice(["function", "method"])
        symbols.append(f(rnd.choice(names), rnd.choice(paths), kind, rnd.choice(owners) if kind == "method" else ""))
    imports = {(rnd.choice(paths), rnd.choice(paths)) for _ in range(30)} | {(rnd.choice(paths), rnd.choice(paths).split("/", 1)[-1]) for _ in range(30)}
    bindings = {}
    for _ in range(240):
        file, local = rnd.choice(paths), rnd.choice([*names, "ns", "*"])
        target = rnd.choice([*paths, None])
        bindings[file, local] = (file, local, "*" if local == "*" else rnd.choice([*names, "*", "*", "ns"]), target, target is None)
    sites = [
        call(i, rnd.choice(paths), rnd.choice(names), rnd.choice([None, None, "ns", "Self", "a::Alpha<T>", "Beta", "n1"]), rnd.choice(["run", "Alpha/run"]))
        for i in range(800)
    ]
    got = {k: v[:2] for k, v in resolved(spark, symbols, sites, sorted(imports), sorted(bindings.values(), key=str)).items()}
    want = brute(symbols, sites, sorted(imports), list(bindings.values()))
    assert got == want
    assert {v[0] for v in want.values()} == set(calls.CONFIDENCE)


def test_module_clauses(spark):
    text = """import { foo as bar, type Baz } from './impl';
import def, { x } from "pkg";
import * as ns from '../ns';
export { baz as shown, qux } from './other';
export * from './all';
export * as grouped from './group';
"""
    files = spark.createDataFrame([("a/barrel.ts", text), ("a/x.py", text)], "relative_path string, content string")
    got = {(r.local, r.imported, r.module) for r in calls.module_clauses(files).collect()}
    assert got == {
        ("bar", "foo", "./impl"), ("Baz", "Baz", "./impl"), ("def", None, "pkg"), ("x", "x", "pkg"), ("ns", "*", "../ns"),
        ("shown", "baz", "./other"), ("qux", "qux", "./other"), ("*", "*", "./all"), ("grouped", "*", "./group"),
    }


def test_callers_and_callees(spark):
    rows = spark.createDataFrame(
        [("a", "f", "alias", "real", "t", 0.95), ("a", "f", "alias", "real", "t", 0.5), ("b", "g", "real", None, None, 0.25), ("c", "h", "real", "real", "u", 0.9)],
        "caller_file string, caller_name string, callee_name string, canonical_name string, resolved_file string, confidence double",
    )
    assert {tuple(r) for r in calls.callers(rows, "real").collect()} == {("a", "f", 0.95), ("b", "g", 0.25), ("c", "h", 0.9)}
    assert {tuple(r) for r in calls.callers(rows, "real", "t").collect()} == {("a", "f", 0.95)}
    assert {tuple(r) for r in calls.callees(rows, "f").collect()} == {("real", "t", 0.95)}


def test_names_seen_through_imports_meet_within_tasks(spark, monkeypatch):
    """Files that import much of what defines much: no row a pair leaves a task, whatever the size of blocks."""
    monkeypatch.setattr(calls, "IN_BLOCK", 40)
    monkeypatch.setattr(calls, "AT_ONCE", 50)
    links = [(f"a{i}", f"m{j}") for i in range(12) for j in range(20) if (i * 7 + j * 3) % 4]
    offers = [(f"m{j}", f"n{k}", bool((j + k) % 2), f"f{(j * 5 + k) % 9}") for j in range(18) for k in range(10) if (j + k) % 3]
    want = {}
    for src, dst in links:
        for d, name, far, file in offers:
            if d == dst:
                want[src, name] = min(want.get((src, name), (True, "z")), (far, file))
    found = calls._sees(spark.createDataFrame(links, "src string, dst string"), spark.createDataFrame(offers, "dst string, name string, far boolean, file string"))
    assert {(r.caller_file, r.callee_name): tuple(r.seen) for r in found.collect()} == want
    assert found.count() == len(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_calls_that_may_mean_a_name(spark):
    """Aliases at first and second hand are kept, all other calls are dropped before anything is resolved."""
    b = [("a.ts", "x", "mid", "b.ts", False), ("b.ts", "mid", "deep", "c.ts", False), ("a.ts", "z", "other", "b.ts", False), ("c.ts", "deep", None, "d.ts", False)]
    made = spark.createDataFrame([(n,) for n in ("x", "mid", "deep", "z", "other", None)], "callee_name string")
    found = calls.naming(made, spark.createDataFrame(b, calls.BINDINGS), "deep")
    assert sorted(r.callee_name for r in found.collect()) == ["deep", "mid", "x"]


def test_calls_without_clauses_do_not_meet_clauses(spark):
    """A clause that is there twice takes or keeps a call once; calls of names without a clause have no key but their own."""
    b = [("a.ts", "x", "one", "b.ts", False)] * 2 + [("b.ts", "one", "q", None, True), ("a.ts", "y", "two", "b.ts", False), ("a.ts", "y", "three", "c.ts", False)]
    made = [(i, "a.ts", "f", None, n, q) for i, (n, q) in enumerate([("x", None), ("y", None), ("z", None), ("z", "x"), ("x", "z")])]
    found = calls.drop_external(spark.createDataFrame(made, CALLS), spark.createDataFrame(b, calls.BINDINGS))
    assert sorted(r.call_id for r in found.collect()) == [1, 2, 4]
