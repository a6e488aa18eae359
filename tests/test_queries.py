"""Every registered query against its SQL, and the entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quarry import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    want = sorted(tuple(normal(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql_unless_it_writes_files():
    # vector_store leaves a folder in place; tests/test_vectors.py holds it against plain rows
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"vector_store"} and set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_verbs_name_registered_queries():
    from quarry.plans import verbs

    known = set(registry.queries())
    assert all(verbs.resolve(v, m) in known for v, modes in verbs.VERBS.items() for m in modes)
    with pytest.raises(KeyError):
        verbs.resolve("search", "nope")
    assert all(q in known for names in verbs.WORKFLOWS.values() for q in names)


def test_workflows_and_batches(spark):
    from quarry.plans import verbs

    found = verbs.workflow("trace_request_path", spark, DATA)
    assert list(found) == ["call_trace", "get_callers", "get_callees"] and all(df.count() for df in found.values())
    one, other = verbs.batch([("overview", "file"), ("overview", "nope")], spark, DATA)
    assert one.count() and isinstance(other, KeyError)
    with pytest.raises(ValueError):
        verbs.batch([("overview", "file")] * 21, spark, DATA)
    with pytest.raises(KeyError):
        verbs.workflow("nope", spark, DATA)
