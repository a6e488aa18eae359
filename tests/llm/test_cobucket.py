import hashlib
import zlib
from collections import Counter, defaultdict
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import cobucket

SALES = "sale_id long, client_id long, status string, total double"
LINES = "sale_id long, line_no int, item_id long, number string"


def crc(text):
    return zlib.crc32(text.encode()) % 300


def key(row):
    return [(x is not None, x.encode() if isinstance(x, str) else x) for x in row]


def brute(sales, lines):
    """Final files by (table, bucket), and starting files, from rows in memory."""
    ids = {r[0] for r in sales if r[0] is not None}
    bucket = lambda i, has: 301 if i is None else crc(f"line{i}") if has else 300
    n_sales, n_lines = Counter(r[0] for r in sales), Counter(r[0] for r in lines)
    joined = Counter()
    for i in ids:
        joined[crc(f"line{i}")] += n_sales[i] * n_lines[i]
    out = {}
    for name, rows in (("sales", sales), ("sale_lines", lines)):
        starts, final = defaultdict(list), defaultdict(list)
        for r in rows:
            b = bucket(r[0], name == "sales" or r[0] in ids)
            s = (b - (b % 3 == 1)) if name == "sales" else 0 if r[2] is None else crc(str(r[2]))
            starts[s].append((b, r))
            final[b].append((s, r))
        for b, found in final.items():
            found = [(s, r) for s, r in sorted(found, key=lambda x: key(x[1]))]
            per = Counter(s for s, _ in found)
            stays = len(per) == 1 and len(starts[next(iter(per))]) == len(found)
            out[name, b] = {
                "rows": [r for _, r in found],
                "ids": hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for _, r in found).encode()).hexdigest(),
                "lineage": hashlib.sha256(",".join(f"{s}:{n}" for s, n in sorted(per.items())).encode()).hexdigest(),
                "joined": joined[b] if b < 300 else 0,
                "rewritten": not stays,
                "start": next(iter(per)),
            }
    return out


def check(sales_rows, lines_rows, got, columns):
    want = brute(sales_rows, lines_rows)
    assert {(r.table_name, r.bucket) for r in got} == set(want) and len(got) == len(want)
    folders = defaultdict(set)
    for r in got:
        w = want[r.table_name, r.bucket]
        path = unquote(urlparse(r.path).path)
        table = pq.read_table(path)
        assert r.columns == ",".join(table.column_names) == ",".join(columns[r.table_name])
        assert [tuple(x.values()) for x in table.to_pylist()] == w["rows"]
        assert (r.n_rows, r.ids_sha256, r.lineage_sha256) == (len(w["rows"]), w["ids"], w["lineage"])
        assert (r.n_joined, r.rewritten) == (w["joined"], w["rewritten"])
        assert path.rsplit("/", 1)[1].startswith(f"bucket-{r.bucket:05d}-" if r.rewritten else f"start-{w['start']:05d}-")
        folders[path.rsplit("/", 1)[0]].add(path.rsplit("/", 1)[1])
    for folder, names in folders.items():
        import os

        assert {x for x in os.listdir(folder) if not x.startswith((".", "_"))} == names
    return want


def rows_of():
    sales = [(i, i % 7, "done" if i % 3 else "öpen", i / 4) for i in range(700)]
    sales += [(5, 1, None, None), (5, 1, "done", 2.0), (None, 3, "x", 1.0), (None, None, None, None)]
    lines = [(i % 650, i % 5, (i * 7) % 90, "n" * (i % 4)) for i in range(4000)]
    lines += [(7, n % 3, 3, "hot") for n in range(3000)] + [(7, 1, 3, "same")] * 500
    lines += [(None, 1, None, "a"), (None, None, 4, None)] * 40 + [(5000 + i, 1, i % 90, "orphan") for i in range(60)]
    lines += [(9, 1, None, "é"), (9, 1, None, "z"), (9, 1, None, None), (9, 1, None, "long" * 50_000)]
    return sales, lines


def test_brute_force(spark):
    sales, lines = rows_of()
    a = spark.createDataFrame(sales, SALES).repartition(3)
    b = spark.createDataFrame(lines, LINES).repartition(5)
    got = cobucket.query(a, b).collect()
    want = check(sales, lines, got, {"sales": a.columns, "sale_lines": b.columns})
    assert any(w["rewritten"] for w in want.values()) and any(not w["rewritten"] for w in want.values())


def test_second_bucket_of_a_file_stays_alone(spark):
    """A file with one bucket stays, whatever its number; one with two is rewritten."""
    by = defaultdict(list)
    for i in range(20_000):
        by[crc(f"line{i}")].append(i)
    one = next(b for b in by if b % 3 == 1)
    both = next(b for b in by if b % 3 == 0 and b != one - 1)
    sales = [(by[one][0], 1, "a", 1.0), (by[both][0], 1, "a", 1.0), (by[both + 1][0], 1, "a", 1.0)]
    item = 17
    lines = [(by[one][0], n, item, "x") for n in range(3)]
    a, b = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
    got = cobucket.query(a, b).collect()
    check(sales, lines, got, {"sales": a.columns, "sale_lines": b.columns})
    stays = {(r.table_name, r.bucket): r.rewritten for r in got}
    assert stays == {("sales", one): False, ("sales", both): True, ("sales", both + 1): True, ("sale_lines", one): False}


@pytest.mark.parametrize("sales,lines", [(True, False), (False, True), (False, False)])
def test_empty_tables(spark, sales, lines):
    s, li = rows_of()
    s, li = s[:40] if sales else [], li[:300] if lines else []
    a, b = spark.createDataFrame(s, SALES), spark.createDataFrame(li, LINES)
    check(s, li, cobucket.query(a, b).collect(), {"sales": a.columns, "sale_lines": b.columns})


def test_clashing_columns(spark):
    """Columns named like the operator's own, in any case."""
    a = spark.createDataFrame([(1, 2, 3, 4), (1, None, 3, 4)], "sale_id long, bucket int, N0 int, s int")
    b = spark.createDataFrame([(1, 2, 3, 4, 5)] * 3, "sale_id long, file int, item_id long, number int, n0 int")
    got = {(r.table_name, r.bucket): r for r in cobucket.query(a, b).collect()}
    assert {k: (r.columns, r.n_rows, r.n_joined) for k, r in got.items()} == {
        ("sales", crc("line1")): ("sale_id,bucket,N0,s", 2, 6),
        ("sale_lines", crc("line1")): ("sale_id,file,item_id,number,n0", 3, 6),
    }


def test_every_call_has_a_folder_that_stays(spark):
    a = spark.createDataFrame([(1, 2, "a", 1.0)], SALES)
    b = spark.createDataFrame([(1, 2, 3, "a")], LINES)
    first = [r.path for r in cobucket.query(a, b).collect()]
    second = [r.path for r in cobucket.query(a, b).collect()]
    assert not {p.rsplit("/", 2)[0] for p in first} & {p.rsplit("/", 2)[0] for p in second}
    assert spark.read.parquet(*[p for p in first if "/sales/" in p]).count() == 1


def test_hash_is_unsigned(spark):
    got = [r.h for r in spark.range(2000).select(cobucket.hashed(F.col("id"), "line").alias("h")).collect()]
    assert got == [crc(f"line{i}") for i in range(2000)]
