"""Operators whose groups may be huge, held against brute force on small inputs, and their shapes on one large group."""

import random
import time

from pyspark.sql import functions as F

from quarry.operators import lookup, telemetry


def calls(spark, rows):
    return spark.createDataFrame(rows, "call_id long, session string, tool string, ms long, args string").withColumn("ts", F.timestamp_millis("ms"))


def test_spans_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        start = rng.randint(0, 400)
        rows.append((rng.choice("fg"), i, start, start + rng.choice([0, 1, 3, 10, 50, 300])))
    rows += [("f", 900, 10, 5), ("f", 901, 7, 7), ("f", 902, 7, 7)]  # one that holds nothing, and two alike
    df = spark.createDataFrame(rows, "file_path string, id long, start_byte long, end_byte long")

    def parent(f, i, s, e):
        around = [(pe - ps, p) for g, p, ps, pe in rows if g == f and p != i and ps <= pe and ps <= s <= pe and pe >= e and (ps < s or pe > e)]
        return min(around)[1] if around else None

    assert {r.id: r.parent_id for r in lookup.nested(df).collect()} == {i: parent(f, i, s, e) for f, i, s, e in rows}
    points = [(k, rng.choice("fgh"), rng.randint(0, 500)) for k in range(200)] + [(900, "f", None), (901, None, 3)]
    spans = df.select("file_path", F.col("id").alias("span_id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("stop"))
    got = lookup.enclosing(spark.createDataFrame(points, "point_id long, file_path string, at long"), spans).collect()

    def smallest(f, at):
        around = [(e - s, s, i) for g, i, s, e in rows if g == f and at is not None and s <= at <= e]
        return min(around)[2] if around else None

    assert len(got) == len(points) and {r.point_id: r.span_id for r in got} == {k: smallest(f, at) for k, f, at in points}
    assert lookup.nested(df.limit(0)).count() == 0


def test_one_file_with_many_spans(spark):
    n = 200_000
    leaves = spark.range(n).select(F.lit("f").alias("file_path"), "id", (F.col("id") * 10).alias("start_byte"), (F.col("id") * 10 + 8).alias("end_byte"))
    blocks = spark.range(n // 100).select(F.lit("f"), F.col("id") + n, F.col("id") * 1000, F.col("id") * 1000 + 999)
    began = time.monotonic()
    got = lookup.nested(leaves.union(blocks))
    assert got.where(f"id < {n} AND parent_id = {n} + id DIV 100").count() == n
    assert time.monotonic() - began < 60  # all pairs would be 40 milliards


def test_sessions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice("xy"), rng.choice([10, 500, 1000, 1500, 2000, 2999, 7000]) + rng.randint(0, 2), rng.choice(["1", None])) for i in range(300)]
    df = calls(spark, rows)
    sessions = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        sessions.setdefault(r[1], []).append(r)
    loops, taken, earlier = [], {}, {}
    for s, own in sessions.items():
        runs = []
        for k, r in enumerate(own):
            if runs and (runs[-1][0], runs[-1][1]) == (r[2], r[4]):
                runs[-1][2] += 1
            else:
                runs.append([r[2], r[4], 1])
            if r[2] == "x" and k + 1 < len(own):
                hit = own[k + 1][2] == "y"
                a, d = taken.get("x", (0, 0))
                taken["x"] = (a + hit, d + (not hit))
            earlier[r[0]] = sum(1 for q in own[:k] if q[3] >= r[3] - 1000)
        loops += [(s, n + 1, t, m) for n, (t, _, m) in enumerate(runs) if m >= 3]
    key = lambda r: (r[0] or "", r[1])
    got = [tuple(r) for r in telemetry.doom_loops(df).select("session", "run", "tool", "length").collect()]
    assert sorted(got, key=key) == sorted(loops, key=key) and len(loops) > 5
    assert {r.tool: (r.accepted, r.diverted) for r in telemetry.suggestions(df, {"x": ["y"]}).collect()} == taken
    assert {r.call_id: r.earlier for r in telemetry.rate_limited(df, 5, 1000).collect()} == earlier
    assert telemetry.doom_loops(df.limit(0)).count() == telemetry.suggestions(df.limit(0), {"x": ["y"]}).count() == 0
