import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor
from time import monotonic

import pytest

from quarry.llm import mixing


def fluid(blocks, weights, slots):
    """Blocks that each source has had after so many slots, if slots could be divided."""
    have = dict.fromkeys(blocks, Fraction(0))
    left = Fraction(slots)
    while left > 0:
        live = {s: weights[s] for s in blocks if have[s] < blocks[s]}
        total = sum(live.values())
        step = min([left] + [(blocks[s] - have[s]) * Fraction(total, w) for s, w in live.items()])
        for s, w in live.items():
            have[s] += step * w / total
        left -= step
    return have


def brute(blocks, weights):
    """(source, block, release, deadline) by slot: of the released blocks, that of (deadline, weight one last, source, number)."""
    total = sum(blocks.values())
    ends = sorted(Fraction(n, weights[s]) for s, n in blocks.items())

    def slots(v):  # dealt when each source has had its weight v times
        return sum(min(Fraction(n), weights[s] * v) for s, n in blocks.items())

    jobs, rounds = {}, -(-ends[-1].numerator // ends[-1].denominator)
    starts = [slots(Fraction(r)) for r in range(rounds + 1)]
    for s, n in blocks.items():
        for k in range(n):
            jobs[s, k] = floor(slots(Fraction(k, weights[s]))), ceil(slots(Fraction(k + 1, weights[s])))
            if weights[s] == 1:  # the whole round, though others may end within it
                jobs[s, k] = int(starts[k]), int(starts[k + 1])
    out, left = [], set(jobs)
    for t in range(total):
        ready = [(jobs[j][1], weights[j[0]] == 1, *j) for j in left if jobs[j][0] <= t]
        due, _, s, k = min(ready)
        assert t < due
        left.remove((s, k))
        out.append((s, k, *jobs[s, k]))
    return out


def order(spark, blocks, weights):
    """(source, block, release, deadline) by slot."""
    got = sorted(mixing.schedule(spark, mixing.tiers(blocks, weights)).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(sum(blocks.values()))) and all(r.release <= r.slot < r.deadline for r in got)
    return [(r.s, r.block, r.release, r.deadline) for r in got]


CASES = [
    ({"a": 5}, {"a": 1}),
    ({"a": 30, "b": 70}, {"a": 3, "b": 7}),
    ({"a": 9, "b": 4, "c": 200}, {"a": 1, "b": 1, "c": 98}),
    ({f"s{i}": 3 + i * i % 17 for i in range(30)}, {f"s{i}": i + 1 for i in range(30)}),
    ({"big": 500, "s0": 3, "s1": 40}, {"big": 9996, "s0": 4, "s1": 17}),
]


@pytest.mark.parametrize("case", range(len(CASES) + 20))
def test_slots_equal_brute_force_and_shares_hold_to_within_a_block(spark, case):
    if case < len(CASES):
        blocks, weights = CASES[case]
    else:
        rnd = random.Random(case)
        names = [f"s{i}" for i in range(rnd.randint(2, 9))]
        blocks = {s: rnd.randint(1, 60) for s in names}
        weights = {s: rnd.choice([1, 2, 3, 7, 50]) for s in names}
    seen = Counter()
    got = order(spark, blocks, weights)
    if sum(blocks.values()) < 600:
        assert got == brute(blocks, weights)
    for t, (s, *_) in enumerate(got, 1):
        seen[s] += 1
        want = fluid(blocks, weights, t)
        assert all(abs(seen[x] - want[x]) < 1 for x in blocks)
    assert seen == blocks


def test_sources_without_a_weight_come_last(spark):
    blocks = {"a": 10, "b": 20, "x": 3, "y": 6}
    got = [s for s, *_ in order(spark, blocks, {"a": 1, "b": 3, "x": 0, "z": 5})]
    assert set(got[:30]) == {"a", "b"} and Counter(got[30:36]) == {"x": 3, "y": 3} and got[36:] == ["y"] * 3
    with pytest.raises(ValueError):
        mixing.tiers({"a": 1}, {"z": 1})
    with pytest.raises(ValueError):
        mixing.tiers({"a": 10**7, "b": 10**7}, {"a": 1, "b": 10**7})


def test_weights_are_exact():
    assert mixing.whole({"a": 0.9996, "b": 0.0004}) == {"a": 2499, "b": 1}
    assert mixing.whole({"a": Fraction(1, 3), "b": "0.5", "c": 2}) == {"a": 2, "b": 3, "c": 12}
    assert mixing.whole({"a": 0, "b": 4}) == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        mixing.whole({"a": -1})
    assert mixing.tempered({"a": 1, "b": 10**8})["a"] == 1


def check(rows, weights):
    """Places are whole blocks in an order whose shares hold to within a block."""
    blocks, sizes = {}, Counter()
    for r in rows:
        sizes[r.source, r.block] += 1
        blocks[r.source] = max(blocks.get(r.source, 0), r.block + 1)
    assert len({(r.slot, r.place) for r in rows}) == len(rows) and all(r.release <= r.slot < r.deadline for r in rows)
    for s, n in blocks.items():
        assert all(sizes[s, b] == mixing.BLOCK_ROWS for b in range(n - 1)) and 1 <= sizes[s, n - 1] <= mixing.BLOCK_ROWS
    at = {r.slot: r.source for r in rows}
    assert sorted(at) == list(range(sum(blocks.values())))
    seen = Counter()
    for t in range(len(at)):
        seen[at[t]] += 1
        want = fluid(blocks, weights, t + 1)
        assert all(abs(seen[x] - want[x]) < 1 for x in blocks)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "t", "hot" if i % 3 else f"s{i % 7}", 1, "x") for i in range(2000)]
    rows += [(1, "t", "hot", 2, "x")] * 40 + [(None, "t", None, 3, "x")] * 200 + [(None, "t", "tiny", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, s string")


def test_every_row_has_a_place(docs):
    got = mixing.query(docs).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
    counts = Counter(r.source for r in got)
    check(got, {s: max(1, round(1000 * n**0.5 / sum(x**0.5 for x in counts.values()))) for s, n in counts.items()})


def test_given_weights(docs):
    weights = {"hot": Fraction(2, 3), "s0": 0.0004, None: "0.25", "tiny": 1, "s1": 1, "s2": 1, "s3": 1, "s4": 1, "s5": 1, "s6": 2}
    got = mixing.places(docs, weights).collect()
    check(got, {s: Fraction(str(w)) for s, w in weights.items()})
    with pytest.raises(ValueError):
        mixing.places(docs, {"z": 1})


def test_mixed_is_the_same_order_and_keeps_all_rows(spark, docs, tmp_path):
    docs.repartition(5).write.parquet(f"{tmp_path}/docs.parquet")
    docs = spark.read.parquet(f"{tmp_path}/docs.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(tuple(r) for r in docs.collect())
    place = sorted(mixing.places(docs).collect(), key=lambda r: (r.slot, r.place))
    assert [g[2] for g in got] == [r.source for r in place]
    unique = [(g[0], g[2]) for g in got if g[0] and g[0] != 1]
    assert unique == [(r.doc_id, r.source) for r in place if r.doc_id and r.doc_id != 1]
    out.write.parquet(f"{tmp_path}/mixed")
    back = mixing.positioned(spark.read.parquet(f"{tmp_path}/mixed")).orderBy("position").collect()
    assert [r.position for r in back] == list(range(len(got))) and [tuple(r)[:-1] for r in back] == got
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 0 and plan.count("REPARTITION_BY_NUM") + plan.count("ShufflePartitionId") >= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.query(docs).count() == 0 and mixing.mixed(docs).count() == 0


def test_many_sources_of_different_sizes(spark):
    """Work in proportion to the blocks: 3,000 sources, all with different ends, and one that is hot."""
    blocks = {f"s{i:05d}": 1 + i // 20 for i in range(3000)} | {"hot": 50_000}
    weights = mixing.tempered({s: 16 * n for s, n in blocks.items()})
    assert weights["hot"] > 1
    start = monotonic()
    got = mixing.schedule(spark, mixing.tiers(blocks, weights))
    row = got.selectExpr("count(*) AS n", "count(DISTINCT slot) AS d", "max(slot) AS m", "sum(int(slot < release OR slot >= deadline)) AS late").first()
    n = sum(blocks.values())
    assert (row.n, row.d, row.m, row.late) == (n, n, n - 1, 0)
    assert monotonic() - start < 60


def test_100_000_sources(spark):
    blocks = {f"s{i:06d}": 1 + i % 7 for i in range(99_999)} | {"hot": 30_000}
    got = mixing.schedule(spark, mixing.tiers(blocks, mixing.tempered({s: 16 * n for s, n in blocks.items()})))
    n = sum(blocks.values())
    assert got.selectExpr("count(DISTINCT slot) AS d", "max(slot) AS m").first() == (n, n - 1)
    with pytest.raises(ValueError):
        mixing.tiers({"a": 1}, {"z": 1})
