"""Session analytics: tool metrics, windows over timelines, audits, limits, leases and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.lookup import numbered
from quarry.storage import written

RING = 256
WINDOW_MS, MAX_CALLS = 60_000, 300


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def metrics(calls: DataFrame) -> DataFrame:
    """Per tool: calls, errors, total, largest and mean time, last call."""
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("failed")).alias("errors"),
        F.round(F.sum("elapsed_ms"), 4).alias("total_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.max("ts").alias("last_called"),
    )


def ring(calls: DataFrame, size: int = RING) -> DataFrame:
    """The last calls of each tool; the best are kept per task before rows move."""
    by = Window.partitionBy("tool").orderBy(F.col("ts").desc(), F.col("call_id").desc())
    return calls.withColumn("n", F.row_number().over(by)).where(F.col("n") <= size).drop("n")


def p95(calls: DataFrame) -> DataFrame:
    """Two definitions over the ring: index (n - 1) * 95 / 100, and ceil(n * .95) - 1."""
    v = F.sort_array(F.collect_list("elapsed_ms"))
    g = ring(calls).groupBy("tool").agg(v.alias("v"))
    n = F.size("v")
    return g.select(
        "tool",
        F.get("v", F.floor((n - 1) * 95 / 100).cast("int")).alias("p95_ring"),
        F.get("v", F.least(F.ceil(n * 0.95).cast("int") - 1, n - 1)).alias("p95_harness"),
    )


def rate_limited(calls: DataFrame, limit: int = MAX_CALLS, window_ms: int = WINDOW_MS) -> DataFrame:
    """Whether each call is rejected: more than ``limit`` earlier calls of its session in the window.

    Rejected calls count as calls. The order within a session is (ts, call_id).  A call counts in its own stretch
    of the window's length and in the next, so that a busy session is as many groups as it has stretches.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    copies = F.when(F.col("_ms").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = calls.withColumn("_ms", ms).withColumn("_copy", F.explode(copies)).withColumn("_cell", F.floor(F.col("_ms") / window_ms) + F.col("_copy"))
    by = Window.partitionBy("session", "_cell").orderBy("_ms").rangeBetween(-window_ms, 0)
    same = Window.partitionBy("session", "_cell", "_ms").orderBy(F.col("call_id").desc())
    earlier = F.count(F.lit(1)).over(by) - F.row_number().over(same)
    rows = rows.withColumn("earlier", earlier.cast("long")).where("_copy = 0").drop("_ms", "_copy", "_cell")
    return rows.withColumn("rejected", F.col("earlier") > limit)


def _in_order(calls: DataFrame, *columns: str | Column) -> DataFrame:
    """Calls with their ``place`` in the order of all sessions: a neighbour is a join away, and no session a task."""
    return written(numbered(calls.select("session", "ts", "call_id", *columns), "session", "ts", "call_id"), "calls-in-order")


def doom_loops(calls: DataFrame, least: int = 3) -> DataFrame:
    """Runs of the same tool with the same arguments in a row, of some length.

    The calls that begin a run are numbered in turn: a run ends where the next one begins.
    """
    rows = _in_order(calls, "tool", F.xxhash64(F.struct("tool", "args")).alias("key"))
    before = rows.select((F.col("place") + 1).alias("place"), F.struct("session", "key").alias("before"))
    begins = rows.join(before, "place", "left").where(~F.struct("session", "key").eqNullSafe(F.col("before")))
    begins = written(numbered(begins.select("session", "tool", F.col("place").alias("at")), "at"), "runs-in-order")
    ends = begins.select((F.col("place") - 1).alias("place"), F.col("at").alias("end"))
    total = rows.agg((F.count(F.lit(1)) + 1).alias("total"))
    first = begins.groupBy("session").agg(F.min("place").alias("first"))
    runs = begins.join(ends, "place", "left").crossJoin(F.broadcast(total))  # one row
    runs = runs.select("session", "tool", "place", (F.coalesce("end", "total") - F.col("at")).alias("length")).where(F.col("length") >= least)
    runs = runs.join(first.withColumnRenamed("session", "_s"), F.col("session").eqNullSafe(F.col("_s")))
    return runs.select("session", (F.col("place") - F.col("first") + 1).alias("run"), "tool", "length")


def suggestions(calls: DataFrame, follow: dict[str, list[str]]) -> DataFrame:
    """Per tool how often the next call of the session is one of those suggested after it."""
    table = F.create_map(*[x for k, v in follow.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    rows = _in_order(calls, "tool")
    after = rows.select((F.col("place") - 1).alias("place"), F.col("session").alias("_s"), F.col("tool").alias("next"))
    rows = rows.join(after, "place").where(F.col("session").eqNullSafe(F.col("_s"))).withColumn("offer", table[F.col("tool")])
    rows = rows.where("next IS NOT NULL AND offer IS NOT NULL")
    return rows.groupBy("tool").agg(
        F.count_if(F.array_contains("offer", F.col("next"))).alias("accepted"),
        F.count_if(~F.array_contains("offer", F.col("next"))).alias("diverted"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Share of all calls, and a bucket, per tool."""
    g = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))
    total = g.agg(F.sum("calls").alias("total"))
    share = F.round(F.col("calls") / F.col("total"), 6)
    return g.crossJoin(F.broadcast(total)).select(  # one row
        "tool", "calls", share.alias("share"), F.when(share >= 0.25, "heavy").when(share >= 0.05, "regular").otherwise("rare").alias("bucket")
    )


STATUS = ("ready", "caution", "blocked")


def worst_status(checks: DataFrame) -> DataFrame:
    """The most severe status of each subject's checks."""
    level = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    return checks.groupBy("subject").agg(F.max_by("status", level).alias("status"))


TRANSITIONS = (("queued", "running"), ("running", "completed"), ("running", "error"), ("queued", "cancelled"), ("running", "cancelled"))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """Events (job, at, seq, state) whose step from the state before is not allowed."""
    by = Window.partitionBy("job").orderBy("at", "seq")
    rows = events.withColumn("before", F.lag("state").over(by))
    ok = F.concat_ws(">", "before", "state").isin([f"{a}>{b}" for a, b in TRANSITIONS])
    return rows.where(F.col("before").isNotNull() & ~ok)


def latest(events: DataFrame) -> DataFrame:
    """The last state of each job."""
    return events.groupBy("job").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("updated"))


#: Sessions that hold one path, of which each two blocks meet in a task.
CLAIM_BLOCK = 256


def overlapping_claims(claims: DataFrame, now: int) -> DataFrame:
    """Pairs of sessions that hold claims on the same path at a time: (a, b, shared).

    A path that more than ``CLAIM_BLOCK`` sessions hold is cut into blocks, each two of which meet on their own.
    """
    live = claims.where(F.col("expires_at") > now).select("session_id", F.explode("paths").alias("path")).distinct()
    size = live.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / CLAIM_BLOCK).cast("int").alias("g")).where("g > 1")
    live = live.join(size, "path", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    live = live.withColumn("block", F.pmod(F.xxhash64("session_id"), F.col("g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    a = live.select("path", F.col("block").alias("i"), other.alias("j"), F.col("session_id").alias("a"))
    b = live.select("path", other.alias("i"), F.col("block").alias("j"), F.col("session_id").alias("b"))
    return a.join(b, ["path", "i", "j"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def page(rows: DataFrame, order: list[str], start: int, size: int) -> DataFrame:
    """Rows [start, start + size) of a total order: only the first ones of each task travel."""
    top = rows.orderBy(*order).limit(start + size)
    n = F.row_number().over(Window.orderBy(*order))  # over at most start + size rows
    return top.withColumn("position", n.cast("long")).where(F.col("position") > start)


def compression_stage(used: Column, budget: Column) -> Column:
    """0 to 4 as a response's size nears and passes its budget."""
    share = used * 100 / budget
    return F.when(share < 75, 0).when(share < 85, 1).when(share < 95, 2).when(share <= 100, 3).otherwise(4)


def sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Extension: native session windows over a timeline."""
    return calls.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("calls"))


#: Keys of a call's arguments that say where it runs, and not what it asks.
ROUTING = ("session_id", "project", "request_id", "trace_id")


def arg_hash(args: Column) -> Column:
    """A hash of a call's arguments as JSON text that does not depend on their order, nor on routing keys."""
    pairs = F.map_entries(F.map_filter(F.from_json(args, "map<string,string>"), lambda k, v: ~k.isin(*ROUTING)))
    return F.xxhash64(F.to_json(F.sort_array(pairs)))


def timeline(calls: DataFrame, most: int = 200) -> DataFrame:
    """(session, timeline): the last ``most`` calls (at, tool) of each session, in order, as a text."""
    by = Window.partitionBy("session").orderBy(F.col("at").desc(), "tool")
    rows = calls.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    entry = F.struct("at", F.concat(F.col("at").cast("string"), F.lit(" "), "tool").alias("t"))
    return rows.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["t"]), "; ").alias("timeline"))
