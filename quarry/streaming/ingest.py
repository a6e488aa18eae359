"""Structured Streaming: file events, upserts per batch, rate limits and leases as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.sources import buckets

EVENTS = "batch long, path string, kind string, at timestamp"


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines by a watcher (``sources/watcher.py``), in the folder or in folders below it."""
    return spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).json(folder)


def normalize(events: DataFrame) -> DataFrame:
    """(kind, path, from_path): within a batch a deletion and a creation of the same base name are a rename."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = events.withColumn("name", name)
    gone = rows.where("kind = 'deleted'").groupBy("batch", "name").agg(F.min("path").alias("from_path"))
    made = rows.where("kind = 'created'").groupBy("batch", "name").agg(F.min("path").alias("path"))
    pairs = made.join(gone, ["batch", "name"]).where("path <> from_path")
    renamed = pairs.select("batch", F.lit("renamed").alias("kind"), "path", "from_path")
    used = pairs.select("batch", "path", F.lit("created").alias("kind")).unionAll(
        pairs.select("batch", F.col("from_path").alias("path"), F.lit("deleted").alias("kind"))
    )
    rest = rows.join(used, ["batch", "path", "kind"], "left_anti").select(
        "batch", "kind", "path", F.lit(None).cast("string").alias("from_path")
    )
    return renamed.unionAll(rest.distinct())


def upsert_stream(events: DataFrame, folder: str, checkpoint: str):
    """Keeps the newest row of each path in a bucketed table under ``folder``: a batch rewrites the buckets it touches.

    The number of a version is its batch, so that a retried batch is the same.  ``buckets.latest`` reads the table.
    """

    def put(batch: DataFrame, number: int) -> None:
        # at one instant the later batch of the watcher wins, and within it what exists over what is deleted
        order = F.struct("at", "batch", F.col("kind") != "deleted", "kind")
        newest = batch.groupBy("path").agg(F.max_by(F.struct("kind", "at"), order).alias("m")).select("path", "m.*")
        buckets.merge(newest.withColumn("deleted", F.col("kind") == "deleted"), folder, "path", number)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _timed(rows: DataFrame, late: str | None) -> tuple[DataFrame, str]:
    """Rows with event time from ``ms``, and the kind of timeout; without a bound for late rows states stay for ever."""
    if late is None:
        return rows, GroupStateTimeout.NoTimeout
    # the first watermark is at zero, and what is not after a watermark is late
    return rows.withColumn("_at", F.timestamp_millis(F.col("ms") + 1)).withWatermark("_at", late), GroupStateTimeout.EventTimeTimeout


def _until(state: GroupState, ms: int, late: str | None) -> None:
    """The state is forgotten when event time, less what may come late, has passed ``ms``."""
    if late is not None:
        state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs()) + 1)


def _limiter(limit: int, window_ms: int, late: str | None):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (session,) = key
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else ())
        # a session's rows of one micro-batch may come in several frames; their order is that of all
        calls = pd.concat(frames)[["ms", "call_id"]].sort_values(["ms", "call_id"])
        out = []
        for ms, call in calls.itertuples(index=False):
            while times and times[0] < ms - window_ms:
                times.popleft()
            out.append((session, call, len(times) > limit))
            times.append(int(ms))
            if len(times) > limit + 2:
                times.popleft()  # more calls than that never change a verdict
        state.update((list(times),))
        _until(state, times[-1] + window_ms, late)
        yield pd.DataFrame(out, columns=["session", "call_id", "rejected"])

    return run


def rate_limit(calls: DataFrame, limit: int = 300, window_ms: int = 60_000, late: str | None = "1 day") -> DataFrame:
    """Exact sliding limit as a stateful operator over a stream of (session, call_id, ms).

    A session without calls for the window is forgotten when the watermark has passed it, without any input of its
    own.  Calls later than ``late`` behind the newest are dropped, as by any watermark; None keeps all, and all states.
    """
    rows, timeout = _timed(calls, late)
    return rows.groupBy("session").applyInPandasWithState(
        _limiter(limit, window_ms, late), "session string, call_id long, rejected boolean", "times array<long>", "append", timeout
    )


def windowed(calls: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: calls per tool and tumbling window, late rows dropped by watermark."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "tool")
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("w.start", "tool", "calls")
    )


def _leaser(ttl_ms: int, late: str | None):
    columns = ["session", "ms", "taken_at", "expires_at", "expired"]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (session,) = key
        last, taken = (state.get if state.exists else (0, 0))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(session, last, taken, last + ttl_ms, True)], columns=columns)
            return
        out = []
        for ms in sorted(int(x) for frame in frames for x in frame["ms"]):
            taken = taken if last and ms <= last + ttl_ms else ms
            last = max(last, ms)
            out.append((session, ms, taken, ms + ttl_ms, False))
        state.update((last, taken))
        _until(state, last + ttl_ms, late)
        yield pd.DataFrame(out, columns=columns)

    return run


def leases(heartbeats: DataFrame, ttl_ms: int = 300_000, late: str | None = "1 minute") -> DataFrame:
    """Leases as state over a stream of heartbeats (session, ms): when each was taken, when it runs out, and if it has.

    A heartbeat in time renews a lease; one that comes too late takes a new one.  When the watermark has passed the
    end of a lease, a last row says that it has expired, without input of its session, and its state is gone.
    Heartbeats later than ``late`` behind the newest are dropped; None keeps all, and nothing expires.
    """
    rows, timeout = _timed(heartbeats, late)
    return rows.groupBy("session").applyInPandasWithState(
        _leaser(ttl_ms, late), "session string, ms long, taken_at long, expires_at long, expired boolean", "last long, taken long", "append", timeout
    )


def live(rows: DataFrame, now: int) -> DataFrame:
    """Leases that have not expired, by their time or, in rows that have it, by the mark of ``leases``."""
    rows = rows.where(F.col("expires_at") > now)
    return rows.where(~F.coalesce("expired", F.lit(False))) if "expired" in rows.columns else rows
