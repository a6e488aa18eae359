"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a stream of blocks of ``block_rows`` documents.  Slots are dealt to the sources that have
blocks left in proportion to their weights, whole numbers without rounding: this fluid schedule fixes when
each block would start and end.  A block is released at the slot in which it starts and due by the one in
which it ends; earliest deadline first, among the released blocks, meets every deadline, because the blocks
that lie within any stretch of slots fill it at most once.  So at every slot, down to the last one, each
source has had its fluid share to within less than one block, and what a used-up source leaves is shared by
the others.  Sources of weight zero, or without a given weight, follow when all others are used up, in equal
shares.

In a round each source that is not used up has as many blocks as its weight.  No block's time goes over the end of
a round, so rounds are scheduled by themselves: each is a row, whose blocks are sorted by release and go through a
queue in the order of (deadline, source, number).  A source of weight one has one block in a round, due by its
end; such blocks take the slots that the others leave, in the order of sources.  The first slot of a round is
the number of all blocks before it.  So the work is in proportion to the blocks, whatever the number of sources or of
their ends; only the sources' names and sizes, ``MAX_SOURCES`` at most, reach the driver, for the weights.  Blocks
in a round of sources of weight two and more are bounded: about 4/3 of ``PERIOD`` where no weights are given,
and ``MAX_ROUND`` where they are; beyond, an error asks for coarser weights or larger blocks.

Documents take their place within a source by a hash of their id, ties by their place in the files.  They are
ranked in a table sorted by source and hash that is dealt by ranges, so that a hot source, and a hot id too,
is many tasks.  For the mix in full, texts are joined with their places and dealt by them.

Defined cases: a null source is a source of its own; null or repeated ids get places of their own; texts of
any length, and extra columns, are not looked at, and columns of the result's names are replaced; an empty
table gives no rows; a table none of whose sources has a weight is an error.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import let, located, written

#: Sum of the weights, about, where none are given.
PERIOD = 1000
BLOCK_ROWS = 16
MAX_SOURCES = 100_000
#: Blocks in a round of sources of weight two and more.
MAX_ROUND = 1 << 16
#: Rounds whose sizes are added up before those of all.
STRIDE = 1024
#: Stands for a null source; names of sources follow a mark, so that none is like it.
NULL, NAMED = "", "="


def whole(weights: dict) -> dict[str, int]:
    """Weights (whole numbers, fractions, decimals) as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("a weight is negative")
    scale = lcm(*[w.denominator for w in exact.values()])
    out = {s: int(w * scale) for s, w in exact.items()}
    common = gcd(*out.values()) or 1
    return {s: w // common for s, w in out.items()}


def tempered(rows: dict[str, int], period: int = PERIOD) -> dict[str, int]:
    """Weights that go with the square root of the sources' numbers of rows; one at least."""
    total = sum(map(sqrt, rows.values()))
    return {s: max(1, round(period * sqrt(n) / total)) for s, n in rows.items()}


def tiers(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[str, int, int, int, float]]:
    """(source, tier, weight, blocks, share) of sources; those without a weight are a tier of their own."""
    first = {s: weights[s] for s in blocks if weights.get(s)}
    if blocks and not first:
        raise ValueError("no source of the table has a weight")
    if sum(min(w, blocks[s]) for s, w in first.items() if w > 1) > MAX_ROUND:
        raise ValueError("the weights need too long a schedule: take coarser ones, or larger blocks")
    total = sum(first.values())
    out = [(s, 0, w, blocks[s], w / total) for s, w in first.items()]
    return out + [(s, 1, 1, n, 0.0) for s, n in blocks.items() if s not in first]


def _jobs(heavy: Column, live: Column) -> Column:
    """Blocks (release, due, s, k) of a round, sorted: each source has m blocks, at most its weight w.

    At block k of weight w a source e has had min(m_e, w_e k / w) blocks, which adds up to a fraction over w.
    """

    def dealt(k: Column, w: Column, ends: Column) -> Column:
        less = F.aggregate(ends, F.lit(0).cast("long"), lambda a, e: a + F.least(e["m"] * w - e["w"] * k, F.lit(0).cast("long")))
        return k * live + less

    def of_ends(ends: Column) -> Column:
        def of_source(h: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0).cast("long"), h["m"] - 1),
                lambda k: F.struct(
                    F.call_function("div", dealt(k, h["w"], ends), h["w"]).alias("release"),
                    F.call_function("div", dealt(k + 1, h["w"], ends) + h["w"] - 1, h["w"]).alias("due"),
                    h["s"].alias("s"),
                    k.alias("k"),
                ),
            )

        return F.array_sort(F.flatten(F.transform(heavy, of_source)))

    return let(F.filter(heavy, lambda e: e["m"] < e["w"]), of_ends)


_READY = "array<struct<due:long,s:string,k:long,release:long>>"
_DONE = "array<struct<s:string,k:long,release:long,due:long,slot:long>>"


def edf(jobs: Column, slots: Column) -> Column:
    """(s, k, release, due, slot) of jobs sorted by release: a queue by deadline is served up to each next release."""

    def step(acc: Column, i: Column, jobs: Column) -> Column:
        job, upto = F.get(jobs, i), F.coalesce(F.get(jobs, i + 1)["release"], slots)

        def served(ready: Column) -> Column:
            at = F.greatest(acc["at"], job["release"])
            n = F.least(F.size(ready).cast("long"), upto - at).cast("int")
            go = F.transform(
                F.slice(ready, F.lit(1), n),
                lambda x, j: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["release"].alias("release"), x["due"].alias("due"), (at + j).alias("slot")),
            )
            return F.struct(
                (at + n).alias("at"),
                F.when(n > 0, F.slice(ready, n + 1, F.size(ready))).otherwise(ready).alias("ready"),
                F.when(n > 0, F.concat(acc["done"], go)).otherwise(acc["done"]).alias("done"),
            )

        new = F.struct(job["due"].alias("due"), job["s"].alias("s"), job["k"].alias("k"), job["release"].alias("release"))
        return let(F.array_sort(F.array_append(acc["ready"], new)), served)

    def of_jobs(jobs: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_READY).alias("ready"), F.array().cast(_DONE).alias("done"))
        places = F.when(F.size(jobs) > 0, F.sequence(F.lit(0), F.size(jobs) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, none, lambda acc, i: step(acc, i, jobs), lambda acc: acc["done"])

    return let(jobs, of_jobs)


def _filled(done: Column, light: Column, slots: Column) -> Column:
    """``done``, and a block of each source of weight one in the slots that are free."""
    free = F.array_except(F.sequence(F.lit(0).cast("long"), slots - 1), F.transform(done, lambda x: x["slot"]))
    zero = F.lit(0).cast("long")

    def fill(free: Column) -> Column:
        more = F.transform(
            light,
            lambda s, i: F.struct(s.alias("s"), zero.alias("k"), zero.alias("release"), slots.alias("due"), F.get(free, i).alias("slot")),
        )
        return F.concat(done, more)

    return let(free, fill)


def schedule(spark: SparkSession, sources: list[tuple[str, int, int, int, float]]) -> DataFrame:
    """(s, block, weight, release, deadline, slot) of all blocks of sources as ``tiers`` returns them."""
    known = spark.createDataFrame(sources, "s string, tier int, w long, b long, weight double")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)
    last = div(F.col("b") + F.col("w") - 1, F.col("w")) - 1
    chunks = known.withColumn("last", last).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("last"), STRIDE))))
    each = chunks.withColumn("r", F.explode(F.sequence(F.col("c") * STRIDE, F.least("last", F.col("c") * STRIDE + STRIDE - 1))))
    each = each.withColumn("m", F.least("w", F.col("b") - F.col("r") * F.col("w")))
    heavy = F.when(F.col("w") > 1, F.struct("s", "w", "m"))
    rounds = written(
        each.groupBy("tier", "c", "r").agg(
            F.sum("m").alias("slots"),
            F.sum("w").alias("live"),
            F.sort_array(F.collect_list(heavy)).alias("heavy"),  # MAX_ROUND at most
            F.sort_array(F.collect_list(F.when(F.col("w") == 1, F.col("s")))).alias("light"),  # MAX_SOURCES at most
        ),
        "mix-rounds",
    )
    before = Window.orderBy("tier", "c").rowsBetween(Window.unboundedPreceding, -1)  # a row for STRIDE rounds
    base = rounds.groupBy("tier", "c").agg(F.sum("slots").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("tier", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = rounds.select("tier", "c", "r", F.coalesce(F.sum("slots").over(within), F.lit(0)).alias("own"))
    starts = starts.join(base, ["tier", "c"]).select("tier", "r", (F.col("base") + F.col("own")).alias("start"))
    done = edf(_jobs(F.col("heavy"), F.col("live")), F.col("slots"))
    jobs = rounds.withColumn("done", done).withColumn("job", F.explode(_filled(F.col("done"), F.col("light"), F.col("slots"))))
    jobs = jobs.select("tier", "r", "job.*").join(starts, ["tier", "r"])
    jobs = jobs.join(F.broadcast(known.select("s", "w", "weight")), "s")  # at most MAX_SOURCES rows
    place = lambda c: (F.col("start") + F.col(c)).alias({"due": "deadline"}.get(c, c))
    return jobs.select("s", (F.col("r") * F.col("w") + F.col("k")).alias("block"), "weight", place("release"), place("due"), place("slot"))


def _named(source: str) -> Column:
    return F.coalesce(F.concat(F.lit(NAMED), F.col(source).cast("string")), F.lit(NULL))


def _keys(rows: DataFrame) -> list[Column]:
    """What a located row is ranked by: its source, the hash of its id, and a hash of its place."""
    return [_named("doc.source").alias("s"), F.xxhash64("doc.doc_id").alias("k"), F.xxhash64("file", "row").alias("t")]


class Schedule:
    """The plan of a table, and the places of its rows."""

    def __init__(self, rows: DataFrame, weights: dict | None, block_rows: int):
        self.spark: SparkSession = rows.sparkSession
        self.block_rows = block_rows
        # sorted by ranges of (source, hash): numbered in order, and a hot source is many partitions
        self.ordered = written(
            rows.select(*_keys(rows), "file", "row", F.col("doc.doc_id").alias("id"), F.col("doc.source").alias("source"))
            .repartitionByRange("s", "k", "t")
            .sortWithinPartitions("s", "k", "t")
            .withColumn("m", F.monotonically_increasing_id()),
            "mix-order",
        )
        part = F.shiftright("m", 33).alias("p")
        counts = self.ordered.groupBy("s", part).agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"))
        self.counts = written(counts, "mix-counts")  # a row a source, and one more a partition, at most
        found = self.counts.groupBy("s").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        have = dict(sorted(map(tuple, found)))
        given = tempered(have) if weights is None else whole({NULL if s is None else f"{NAMED}{s}": w for s, w in weights.items()})
        sources = tiers({s: -(-n // block_rows) for s, n in have.items()}, given)
        self.slots = sum(b for _, _, _, b, _ in sources)
        self.blocks = written(schedule(self.spark, sources), "mix-blocks")

    def ranked(self) -> DataFrame:
        """(s, k, t, file, row, id, source, rank): all rows, with their rank within the source."""
        before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        base = self.counts.select(
            "s", "p", (F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")) - F.col("low")).alias("base")
        )
        rows = self.ordered.withColumn("p", F.shiftright("m", 33)).join(F.broadcast(base), ["s", "p"])
        return rows.withColumn("rank", F.col("base") + F.col("m")).drop("p", "m", "base")

    def placed(self) -> DataFrame:
        """All rows with their weight, block, release, deadline, slot and place in the block."""
        block = F.floor(F.col("rank") / self.block_rows).cast("long")
        rows = self.ranked().withColumn("block", block).withColumn("place", (F.col("rank") % self.block_rows).cast("int"))
        return rows.join(self.blocks, ["s", "block"])


_PLACE = ("weight", "block", "release", "deadline", "slot", "place")


def places(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, weight, block, release, deadline, slot, place): sorted by slot and place, the mix.

    ``weight`` is the source's share of the slots before any source is used up; zero for those that follow.
    """
    plan = Schedule(located(docs.select("doc_id", "source")), weights, block_rows)
    return plan.placed().select(F.col("id").alias("doc_id"), "source", *_PLACE)


def mixed(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All documents in the order of the mix: partition by partition, and in order within each."""
    rows = located(docs)
    plan = Schedule(rows, weights, block_rows)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("slot") * F.lit(parts) / F.lit(max(1, plan.slots))).cast("int")
    out = rows.join(plan.placed().select("file", "row", "slot", "place"), ["file", "row"])
    out = out.repartitionById(parts, part).sortWithinPartitions("slot", "place")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def positioned(docs: DataFrame) -> DataFrame:
    """``docs``, as read from the Parquet files that ``mixed`` was written to, with each row's position in the mix.

    Files are numbered by partition, and rows by their place in a file, whatever split reads them.
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = docs.select("*", name.alias("_file"), row.alias("_row"))
    sizes = docs.groupBy(name.alias("_file")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a file
    base, at = [], 0
    for file, n in sorted((tuple(r) for r in sizes), key=lambda x: (int(x[0].split("-")[1]), x[0])):
        base.append((file, at))
        at += n
    bases = docs.sparkSession.createDataFrame(base, "_file string, _base long")
    rows = rows.join(F.broadcast(bases), "_file")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "position"], (F.col("_base") + F.col("_row")).alias("position"))


def query(docs: DataFrame) -> DataFrame:
    return places(docs)
