"""Event streams: daily telemetry and request limits, each with a twin for batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITED = "event_id long, allowed boolean, remaining long, retry_after_s long"


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day and type: events, clients and value.  On a stream, with a watermark, clients are an approximate count; in a batch an exact one."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.countDistinct("user_id")
    return e.groupBy(F.window("ts", "1 day").alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("events"), users.alias("clients"), F.round(F.sum("value"), 4).alias("value")).select(F.col("_w.start").alias("day"), "event_type", "events", "clients", "value")


def hit(ns: int, start: int | None, count: int, limit: int, window_ns: int) -> tuple[int, int, tuple[bool, int, int]]:
    """(start of the window, its count, (allowed, remaining, seconds to its end)) after a request; a window opens at the first request after the last has ended."""
    if start is None or start + window_ns <= ns:
        start, count = ns, 0
    count += 1
    return start, count, (count <= limit, max(0, limit - count), max(1, -((ns - start - window_ns) // 10**9)))


def limited(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, allowed, remaining, retry_after_s of each request (event_id, key, ts), in order of time by key.

    Rows are dealt by key and sorted; a task walks them with the state of one key, so no key's requests are held at once.
    """
    window_ns = seconds * 10**9

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, start, count = None, None, 0
        for f in frames:
            out = []
            for key, ns in zip(f["key"], f["ts"].astype("datetime64[ns]").astype("int64")):
                if key != of:
                    of, start, count = key, None, 0
                start, count, row = hit(ns, start, count, limit, window_ns)
                out.append(row)
            yield pd.DataFrame({"event_id": f["event_id"], **dict(zip(("allowed", "remaining", "retry_after_s"), zip(*out)))}) if out else pd.DataFrame({"event_id": [], "allowed": [], "remaining": [], "retry_after_s": []})

    return events.repartition("key").sortWithinPartitions("key", "ts", "event_id").select("event_id", "key", "ts").mapInPandas(run, LIMITED)


def limited_stream(events: DataFrame, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: a key's open window is its state, dropped when the watermark has passed its end, however long the stream stands still.

    Requests of a batch are taken in order of time; those older than the watermark are left out.
    """
    window_ns = seconds * 10**9

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for ns in f["ts"].astype("datetime64[ns]").astype("int64"):
            start, count, row = hit(int(ns), start, count, limit, window_ns)
            out.append(row)
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + window_ns) // 10**6, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": f["event_id"].to_numpy(), **dict(zip(("allowed", "remaining", "retry_after_s"), zip(*out)))})

    return events.select("event_id", "key", "ts").withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, LIMITED, "start long, count int", "append", "EventTimeTimeout")
