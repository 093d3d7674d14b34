"""Rules over a live stream of tool events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TTL_SECONDS = 3600


def failure_streaks(events: DataFrame, key: str, ttl_seconds: int = TTL_SECONDS, forget: bool = True) -> DataFrame:
    """(key, event_id, streak) of failures in a stream (ts timestamp, event_id, key, failed): as the batch form, where
    events come in order. State is a count and a time for each key; it goes after the ttl unless forget is False, which a
    run to the end of what is there needs (a clock that runs on would keep it alive)."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last = state.get if state.exists else (0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, event, failed in zip(rows.ts, rows.event_id, rows.failed):
            now = ts.value // 1000
            if not failed:
                count = 0
            else:
                count = count + 1 if count and now - last <= ttl_seconds * 1_000_000 else 1
                out.append((own[0], event, count))
            last = now
        state.update((count, last))
        if forget:
            state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame(out, columns=[key, "event_id", "streak"])

    schema = f"{key} {events.schema[key].dataType.simpleString()}, event_id long, streak long"
    return events.groupBy(key).applyInPandasWithState(step, schema, "count long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def warn_once(events: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """The first event of each key within the time, in a stream with column ts."""
    return events.withWatermark("ts", f"{minutes} minutes").dropDuplicatesWithinWatermark(keys)


def call_results(calls: DataFrame, results: DataFrame, minutes: int = 10) -> DataFrame:
    """(call_id, duration_ms) of calls and results (call_id, ts) that come within the time of each other."""
    a = calls.select("call_id", F.col("ts").alias("called")).withWatermark("called", f"{minutes} minutes")
    b = results.select(F.col("call_id").alias("_id"), F.col("ts").alias("answered")).withWatermark("answered", f"{minutes} minutes")
    on = (F.col("call_id") == F.col("_id")) & (F.col("answered") >= F.col("called")) & (F.col("answered") <= F.col("called") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(b, on).select("call_id", ((F.unix_micros("answered") - F.unix_micros("called")) / 1000).cast("long").alias("duration_ms"))
