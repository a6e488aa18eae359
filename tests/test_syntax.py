import pytest
from pyspark.sql import functions as F

from quarry.functions import syntax

RUST = '''//! fn hidden() { "quote
use std::fmt;
pub struct Ring<'a> { name: &'a str }
struct Unit;
impl<'a, T: Fn(u8) -> u8> fmt::Display for Ring<'a> where T: Clone {
    #[inline]
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        let s = "write(\\"x\\") { "; /* close(1) /* nested */ { */
        if check(self.name) { write!(f, "{}", s) } else { other::<u8>('{', '"', b'\\n') }
    }
}
trait Shape {
    fn area(&self) -> f64;
    fn twice(&self) -> f64 { self.area() * 2.0 }
}
const LIMIT: usize = limit();
fn outer<F: Fn() -> u8>(
    f: F,
    g: impl Fn(u8),
) -> u8 {
    fn inner() { deep(r#"a " b() { "#) }
    inner();
    f()
}
'''
RUST_SYMBOLS = [
    ("Ring", "class", "Ring", 3, 3), ("Unit", "class", "Unit", 4, 4), ("fmt", "method", "Ring/fmt", 7, 10), ("Shape", "interface", "Shape", 12, 15),
    ("area", "method", "Shape/area", 13, 13), ("twice", "method", "Shape/twice", 14, 14), ("LIMIT", "variable", "LIMIT", 16, 16),
    ("outer", "function", "outer", 17, 24), ("inner", "function", "outer/inner", 21, 21),
]
RUST_CALLS = [
    ("check", "Ring/fmt", 9), ("write", "Ring/fmt", 9), ("other", "Ring/fmt", 9), ("area", "Shape/twice", 14), ("limit", "<module>", 16),
    ("deep", "outer/inner", 21), ("inner", "outer", 22), ("f", "outer", 23),
]
TS = '''import { a } from "./a";
/* class Hidden { */
export class Box<T> extends Base {
  #small = 1; // call(1)
  private async run(x: { a: number }, cb: (n: number) => void): Promise<void> {
    const t = `text ${format(x)} { end`;
    if (/[/"]{/.test(t)) { cb(this.#small); }
    await load<string>('}');
  }
  get size(): number { return measure(this); }
}
interface Shape { area(): number; }
type Id = string | { id: number };
export const add = (a: number, b: number): number => {
  return sum(a, b);
};
const one = async x => wrap(x);
function* items(list) {
  for (const i of list) { yield make(i); }
}
enum Color { Red, Green }
'''
TS_SYMBOLS = [
    ("Box", "class", "Box", 3, 11), ("run", "method", "Box/run", 5, 9), ("size", "method", "Box/size", 10, 10), ("Shape", "interface", "Shape", 12, 12),
    ("Id", "type_alias", "Id", 13, 13), ("add", "function", "add", 14, 16), ("one", "function", "one", 17, 17), ("items", "function", "items", 18, 20), ("Color", "enum", "Color", 21, 21),
]
TS_CALLS = [
    ("format", "Box/run", 6), ("test", "Box/run", 7), ("cb", "Box/run", 7), ("load", "Box/run", 8), ("measure", "Box/size", 10), ("sum", "add", 15),
    ("wrap", "one", 17), ("make", "items", 19),
]
GO = '''package main
// func hidden() {
type Ring struct { name string }
type Shape interface { Area() float64 }
type ID int
func (r *Ring) Run(x int, f func(int) bool) (string, error) {
	s := `raw { "
` + "}" + string('{')
	if ok := f(x); ok { return fmt.Sprintf("%d", x), nil }
	go spawn(func() { inner(s) })
	return "", nil
}
func Free[T any](x T) T { return Map[T](x) }
func main() { defer close(ch); Free(1) }
'''
GO_SYMBOLS = [
    ("Ring", "class", "Ring", 3, 3), ("Shape", "interface", "Shape", 4, 4), ("ID", "type_alias", "ID", 5, 5), ("Run", "method", "Run", 6, 12),
    ("Free", "function", "Free", 13, 13), ("main", "function", "main", 14, 14),
]
GO_CALLS = [
    ("string", "Run", 8), ("f", "Run", 9), ("Sprintf", "Run", 9), ("spawn", "Run", 10), ("inner", "Run", 10), ("close", "main", 14), ("Free", "main", 14),
]
JAVA = '''package x;
/** class Hidden { */
public class Ring<T> extends Base implements Shape {
    private final String name = make("{");
    public Ring(String name) { this.name = check(name); }
    @Override
    public <U> List<U> run(int x, Map<String, U> m) throws IOException {
        String s = """
            text { call() "
            """;
        for (U u : m.values()) { if (x > 1) return list(u); }
        Runnable r = () -> { go(s); };
        return new ArrayList<>(x);
    }
    static int twice(int x) { return x * helper(x); }
}
interface Shape { double area(); }
enum Color { RED, GREEN }
'''
JAVA_SYMBOLS = [
    ("Ring", "class", "Ring", 3, 16), ("Ring", "method", "Ring/Ring", 5, 5), ("run", "method", "Ring/run", 7, 14), ("twice", "method", "Ring/twice", 15, 15),
    ("Shape", "interface", "Shape", 17, 17), ("area", "method", "Shape/area", 17, 17), ("Color", "enum", "Color", 18, 18),
]
JAVA_CALLS = [
    ("make", "<module>", 4), ("check", "Ring/Ring", 5), ("values", "Ring/run", 11), ("list", "Ring/run", 11), ("go", "Ring/run", 12),
    ("ArrayList", "Ring/run", 13), ("helper", "Ring/twice", 15),
]
KOTLIN = '''package x
/* fun hidden() { /* nested */ } */
class Ring(val name: String) : Base(name), Shape {
    override fun run(x: Int): String {
        val s = """raw { " """
        return if (x > 1) format(s) else "}".trim()
    }
    fun twice(x: Int) = helper(x) * 2
}
interface Shape { fun area(): Double }
fun <T> List<T>.second(): T { return get(1) }
enum class Color { RED, GREEN }
object Single { fun go() { Ring("a").run(2) } }
'''
KOTLIN_SYMBOLS = [
    ("Ring", "class", "Ring", 3, 9), ("run", "method", "Ring/run", 4, 7), ("twice", "method", "Ring/twice", 8, 8), ("Shape", "interface", "Shape", 10, 10),
    ("area", "method", "Shape/area", 10, 10), ("second", "function", "second", 11, 11), ("Color", "enum", "Color", 12, 12), ("Single", "class", "Single", 13, 13), ("go", "method", "Single/go", 13, 13),
]
KOTLIN_CALLS = [
    ("format", "Ring/run", 6), ("trim", "Ring/run", 6), ("helper", "Ring/twice", 8), ("get", "second", 11), ("Ring", "Single/go", 13), ("run", "Single/go", 13),
]
FIXTURES = {
    "rs": (RUST, RUST_SYMBOLS, RUST_CALLS), "ts": (TS, TS_SYMBOLS, TS_CALLS), "go": (GO, GO_SYMBOLS, GO_CALLS),
    "java": (JAVA, JAVA_SYMBOLS, JAVA_CALLS), "kt": (KOTLIN, KOTLIN_SYMBOLS, KOTLIN_CALLS),
}


def f1(got, want):
    got, want = set(got), set(want)
    return 2 * len(got & want) / (len(got) + len(want))


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([(e, x[0]) for e, x in FIXTURES.items()], "ext string, content string")
    out = files.select("ext", F.explode(syntax.parsed(F.col("content"), F.col("ext"))).alias("r")).select("ext", "r.*").collect()
    return {e: [r for r in out if r.ext == e] for e in FIXTURES}


@pytest.mark.parametrize("ext", FIXTURES)
def test_symbols_and_calls(rows, ext):
    _, symbols, calls = FIXTURES[ext]
    got = sorted(((r.name, r.kind, r.name_path, r.line, r.end_line) for r in rows[ext] if r.row == "symbol"), key=lambda r: (r[3], -r[4], r[2]))
    assert f1(got, symbols) == 1.0, (sorted(set(got) - set(symbols)), sorted(set(symbols) - set(got)))
    found = [(r.name, r.name_path, r.line) for r in rows[ext] if r.row == "call"]
    assert f1(found, calls) >= 0.85, (sorted(set(found) - set(calls)), sorted(set(calls) - set(found)))


MASKS = [
    ("rs", "fn run<'a>(small_ring: &'a str) {", "fn run<'a>(small_ring: &'a str) {"),
    ("rs", "#[cfg(test)] small_ring();", "#[cfg(test)] small_ring();"),
    ("py", "x = a // small_ring # b", "x = a // small_ring    "),
    ("ts", "this.#small_ring", "this.#small_ring"),
    ("rs", "/* small_ring */ x", "                 x"),
    ("c", "/* a\nsmall_ring\n*/ y = 1'000 + '\\''; // z", "    \n          \n   y = 1'000 +     ;     "),
    ("py", '"""a\nsmall_ring \' # """ x = f\'y\' # z', "    \n" + " " * 18 + " x = f" + " " * 7),
    ("js", "`a ${small_ring} b` = /x\"y/g", "     small_ring     =      g"),
    ("go", "`raw \\` + x // \"", " " * 7 + " + x     "),
    ("txt", "it's # the 'x' // \"the\" end", "it" + " " * 10 + "x'" + " " * 13),
]


def test_masks(spark):
    cases = [(i, e, t, m) for i, (e, t, m) in enumerate(MASKS)]
    df = spark.createDataFrame(cases, "i int, ext string, t string, want string").withColumn("got", syntax.mask(F.col("t"), F.col("ext")))
    for r in df.collect():
        assert r.got == r.want, r
    odd = spark.createDataFrame([(None, "rs"), ("", "rs"), ("a", None), ("\"" + "x\\\"" * 30_000 + "\"", "rs"), ("/*" + "*" * 100_000, "kt"), ("'" * 99_999, "ts")], "t string, ext string")
    got = [r.m for r in odd.select(syntax.mask(F.col("t"), F.col("ext")).alias("m")).collect()]
    assert got[:3] == ["", "", "a"] and got[3] == " " * 90_002 and got[4] == " " * 100_002 and len(got[5]) == 99_999


def test_odd_texts_parse(spark):
    texts = [None, "", "}}}}", "{{{{", "fn", "fn a(", "class", "fn a() {" * 300, "f(" * 3000, "impl X {\n" + "fn a() { b() }\n" * 3000 + "}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", syntax.parsed(F.col("t"), F.lit("rs")).alias("r")).collect()}
    assert [len(got[i]) for i in range(5)] == [0] * 5
    assert len([r for r in got[9] if r.row == "symbol"]) == 3000 and {r.name_path for r in got[9]} == {"X/a"}
