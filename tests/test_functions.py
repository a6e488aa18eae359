from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_identifiers(spark):
    for name, words in (("getUserName", "get User Name"), ("parse_http_url", "parse http url"), ("HTTPServer", "HTTP Server"), ("ABC", "ABC")):
        assert one(spark, T.split_identifier(F.col("n")), n=name) == words
    assert one(spark, T.tokens(F.col("n")), n="Foo_bar a baz_x") == ["foo_bar", "foo", "bar", "baz_x", "baz"]
    assert one(spark, T.query_tokens(F.col("n")), n="find the Parse parse for xy") == ["find", "parse"]
    assert one(spark, T.has_word(F.col("a"), F.col("b")), a="parse_json", b="parse")
    assert not one(spark, T.has_word(F.col("a"), F.col("b")), a="parser", b="parse")


def test_symbol_ids(spark):
    got = one(spark, T.parse_symbol_id(F.col("s")), s="src/a.rs#function:A/b")
    assert tuple(got) == ("src/a.rs", "function", "A/b")
    assert one(spark, T.parse_symbol_id(F.col("s")), s="no id") is None


def test_bytes_and_frontmatter(spark):
    assert one(spark, T.byte_slice(F.col("t"), F.lit(1), F.lit(3)), t="aéb") == "é"
    assert one(spark, T.byte_line(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    assert tuple(one(spark, T.frontmatter(F.col("t")), t="---\nk: v\n---\nbody")) == ("k: v", "body")
    assert tuple(one(spark, T.frontmatter(F.col("t")), t="plain")) == ("", "plain")


def test_vectors_and_sets(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in rows.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0, 1, 0]
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None


def test_thresholds_and_roles(spark):
    assert one(spark, T.duplicate_threshold(0.85, F.col("a"), F.col("b")), a="ci.yml", b="src/lib.rs") == 0.95
    assert one(spark, T.role_boost(F.col("a")), a="src/foo_handler.rs") == 0.10
    assert one(spark, T.change_kind(F.col("s"), F.col("d")), s="M", d=0) == "additive"


def test_globs():
    import re

    assert re.match(T.glob_regex("a*.r?"), "abc.rs") and not re.match(T.glob_regex("a*.rs"), "abc.py")


def test_test_symbols(spark):
    rows = [
        ("a/tests/x.rs", "f", "f", "function", "", 0, True), ("a/x_tests.rs", "f", "f", "function", "", 0, True), ("a/x.spec.ts", "f", "f", "function", None, 0, True),
        ("FooTest.java", "f", "f", "method", "", 0, True), ("a.rs", "f", "tests::f", "function", "", 0, True), ("a.rs", "f", "m::test::f", "function", "", 0, True),
        ("a.rs", "f", "f", "function", "#[test]\nfn f()", 8, True), ("a.rs", "f", "f", "function", "#[test]" + " " * 3000 + "fn f()", 3007, False),
        ("a.rs", "f", "f", "function", "fn f() #[test]", 0, False), ("a.py", "test_f", "f", "function", "", 0, True), ("a.py", "test_f", "f", "function", None, 0, False),
        ("a.py", "TestX", "f", "class", "", 0, True), ("a.go", "TestX", "f", "function", "", 0, True), ("a.go", "TestX", "f", "method", "", 0, False),
        ("A.kt", "f", "f", "method", "@Test\nfun f()", 6, True), ("A.rs", "f", "f", "method", "@Test\nfun f()", 6, False), ("latest.rs", "f", "f", "function", "", 0, False),
    ]
    df = spark.createDataFrame(rows, "p string, n string, np string, k string, s string, b int, want boolean")
    c = F.col
    got = [r for r in df.select(T.is_test_symbol(c("p"), c("n"), c("np"), c("k"), c("s"), c("b")).alias("got"), "want", "p", "n").collect()]
    assert [(r.p, r.n, r.got) for r in got] == [(r.p, r.n, r.want) for r in got]
