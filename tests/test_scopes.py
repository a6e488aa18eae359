"""Scopes of scripts: shadowed, hoisted, destructured and exported names; odd and very long files."""

import random
import time

from quarry.operators import scopes
from quarry.sources import scripts

SOURCE = """import D, {a as b, type C} from "m";
import * as ns from "n"; import "side";
export const x = 1, y: Map<string, C> = new Map<string, C>();
let count = 0;
export async function outer<T>(p: T, {q, r: s = x}: any, ...rest): Promise<string> {
  var hoisted = p;
  if (q) { let x = 2; var deep = x; count += x; }
  for (const i of rest) { use(i); }
  try { s(); } catch (e) { throw e; }
  return deep + hoisted + label;
}
export class Ring<U> extends Base {
  size = count;
  constructor(private a, c = x) { super(); this.a = c; }
  get area(): number { return this.size; }
  run(x) { const f = (z) => z + x; return arr.map(v => v * y).map((w): number => { return w; }); }
}
interface Shape { area: number; grow(by: number): void }
type Pair<A> = [A, Shape];
const o = { key: count, short: D, x, m(k) { return k; } };
switch (x) { case y: { let x = b; ns.go(x); } default: { x; } }
count++;
export { o as other };
const g = function inner() { return inner; };
var hoist = 1; { var hoist = 2; }
/* count */ const t = `count ${count} text`; // count
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "relative_path string, content string")


def test_names_mean_the_nearest_declaration(spark):
    names = scripts.names(files(spark, ("a.ts", SOURCE), ("b.py", SOURCE), ("c.js", None), ("d.js", ""))).cache()
    got = scopes.references(names).collect()
    assert {r.file_path for r in got} == {"a.ts"}
    uses = lambda n: sorted((r.line, r.kind, r.declared_line) for r in got if r.name == n and r.kind != "definition")
    assert uses("x") == [
        (5, "read", 3), (7, "read", 7), (7, "read", 7), (14, "read", 3), (16, "read", 16), (20, "read", 3), (21, "read", 3), (21, "read", 3), (21, "read", 21),
    ]
    assert uses("count") == [(7, "write", 4), (13, "read", 4), (20, "read", 4), (22, "write", 4), (26, "read", 4)]
    assert uses("deep") == [(10, "read", 7)] and uses("s") == [(9, "read", 5)] and uses("b") == [(21, "read", 1)]
    assert uses("inner") == [(24, "read", 24)] and uses("k") == [(20, "read", 20)] and uses("A") == [(19, "read", 19)]
    missing = {r.name: r.uses for r in scopes.unresolved(names).collect()}
    assert missing == {"Map": 2, "Promise": 1, "use": 1, "label": 1, "Base": 1, "arr": 1}
    by_name = {}
    for r in scopes.symbols(names).collect():
        by_name.setdefault(r.name, []).append(r)
    assert sorted(n for n, rows in by_name.items() if any(r.exported for r in rows)) == ["Ring", "o", "outer", "x", "y"]
    assert [(r.mutated, r.reference_count) for r in by_name["count"]] == [(True, 5)] and by_name["C"][0].how == "import"
    assert len(by_name["hoist"]) == 1 and by_name["Shape"][0].reference_count == 1
    assert {r.name for r in scopes.references(names, "deep").collect()} == {"deep"}


def test_odd_files_are_walked(spark):
    rng = random.Random(5)
    words = "{ } ( ) [ ] < > , ; : = => ... ? . function class let const var for of in import export from as case default catch type interface a b c * ++ += \n # async get".split(" ")
    for _ in range(3000):
        list(scripts._Walk(" ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))).rows("f"))
    deep = "let " + "[" * 3000 + "a" + "]" * 3000 + " = 1; a;"
    assert [r[5] for r in scripts._Walk(deep).rows("f")] == ["definition", "read"]
    assert scopes.references(scripts.names(files(spark).limit(0))).count() == 0


def test_a_long_file_is_linear():
    began = time.monotonic()
    rows = list(scripts._Walk("function f(a) { const b = (c) => a + c; return b; }\nclass K { run(x) { return x; } }\n" * 20_000).rows("f"))
    assert len(rows) == 20_000 * 10 and time.monotonic() - began < 30
