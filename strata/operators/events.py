"""Rules over a log of tool events, as batch windows; strata.streaming has the live forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_streaks(events: DataFrame, key: str, failed: Column, ttl_seconds: int | None = 3600) -> DataFrame:
    """events (ts, event_id, key) that failed, with `streak`: failures in a row of the key, started anew by a success or,
    with a ttl, by a failure more than that long after the one before."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = events.withColumn("_bad", failed)
    fresh = F.lit(False) if ttl_seconds is None else F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order) > ttl_seconds * 1_000_000, F.lit(False))
    start = ~F.col("_bad") | fresh
    island = marked.withColumn("_start", start).withColumn("_island", F.sum(F.col("_start").cast("int")).over(order)).filter("_bad")
    return island.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_island").orderBy("ts", "event_id"))).drop("_bad", "_start", "_island")


def call_durations(events: DataFrame, key: str, call: Column, result: Column) -> DataFrame:
    """Calls (event_id, key) with `duration_ms` to the next event of the key if that is a result, -1 otherwise."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    next_ok = F.coalesce(F.lead(result).over(order), F.lit(False))
    paired = events.withColumn("_call", call).withColumn("duration_ms", F.when(next_ok, F.floor((F.lead(micros).over(order) - micros) / 1000)).otherwise(-1).cast("long"))
    return paired.filter("_call").select("event_id", key, "duration_ms")


def last_before(events: DataFrame, key: str, test: Column, name: str) -> DataFrame:
    """events with `name`: the time of the key's last event that passes the test, up to and with each row."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(F.when(test, F.col("ts")), ignorenulls=True).over(order))


def fresh_checks(events: DataFrame, key: str, check: Column, edit: Column, valid_seconds: int = 300) -> DataFrame:
    """(event_id, fresh): whether a check at most that long ago has no edit after it."""
    both = last_before(last_before(events, key, check, "_check"), key, edit, "_edit")
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_check").cast("timestamp"))
    ok = F.col("_check").isNotNull() & (age <= valid_seconds * 1_000_000) & (F.col("_edit").isNull() | (F.col("_edit") <= F.col("_check")))
    return both.select("event_id", F.coalesce(ok, F.lit(False)).alias("fresh"))


def spaced(events: DataFrame, key: list[str], gap_seconds: int) -> DataFrame:
    """The events of each key that come at least gap_seconds after the last one kept: a fold, as what is kept depends on it.

    An event as long after the one before it is kept whatever came before, so a key's events are cut there and only the runs
    between such gaps are folded, each by itself.
    """
    micros, gap = F.unix_micros(F.col("ts").cast("timestamp")), gap_seconds * 1_000_000
    order = Window.partitionBy(*key).orderBy("_t", "event_id")
    cut = events.select(*key, "event_id", micros.alias("_t")).withColumn("_first", F.coalesce(F.col("_t") - F.lag("_t").over(order) >= gap, F.lit(True)).cast("int"))
    runs = cut.withColumn("_run", F.sum("_first").over(order)).groupBy(*key, "_run").agg(F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), "event_id"))).alias("_all"))
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, e: Column) -> Column:
        keep = acc["last"].isNull() | (e["t"] - acc["last"] >= gap)
        return F.when(keep, F.struct(e["t"].alias("last"), F.concat(acc["ids"], F.array(e["event_id"])).alias("ids"))).otherwise(acc)

    return runs.select(*key, F.explode(F.aggregate("_all", empty, step, lambda a: a["ids"])).alias("event_id"))


def every_nth(events: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Each n-th event of a key, with its number."""
    numbered = events.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id")))
    return numbered.filter(F.col("number") % n == 0)


def changes_only(events: DataFrame, key: str, value: str) -> DataFrame:
    """Events whose value differs from the key's one before, the first included."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("_before", F.lag(value).over(order)).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def tail(events: DataFrame, key: str, above: int, keep: int) -> DataFrame:
    """Of keys with more than `above` events the last `keep`; all of the others'."""
    sized = events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    ranked = sized.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))))
    return ranked.filter((F.col("_n") <= above) | (F.col("_k") <= keep)).drop("_n", "_k")


def pending(events: DataFrame, key: str, level: Column, cleared: Column) -> DataFrame:
    """(event_id, pending): the highest level of a key's events since the last that cleared it."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    island = events.withColumn("_level", level).withColumn("_island", F.sum(cleared.cast("int")).over(order))
    return island.select("event_id", F.max("_level").over(Window.partitionBy(key, "_island").orderBy("ts", "event_id")).alias("pending"))


def surviving(events: DataFrame, key: str, edit: Column, failed: Column, most: int = 100) -> DataFrame:
    """(key, event_id): the last `most` edits of each key that the key's next event doesn't report as failed."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    undone = F.coalesce(F.lead(failed).over(order), F.lit(False))
    held = events.withColumn("_edit", edit).withColumn("_undone", undone).filter("_edit AND NOT _undone")
    last = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return held.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= most).select(key, "event_id")


def blocked_edits(events: DataFrame, key: str, level: Column, cleared: Column, edit: Column, free: Column, available: bool = True) -> DataFrame:
    """(event_id) of edits while a level of 1 or more is pending, `free` ones excepted; none where the clearing tool isn't there."""
    gated = pending(events, key, level, cleared).filter("pending >= 1")
    return events.filter(edit & ~free & F.lit(available)).select("event_id").join(gated.select("event_id"), "event_id", "left_semi")


def ladder(events: DataFrame, key: str, failed: Column) -> DataFrame:
    """(event_id, number, step, last_failure): failures of a key by number, 1 and 2 brief, 3 and 4 targeted, then strong; targeted
    ones name the key's failure before."""
    own = events.filter(failed)
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    n = F.col("number")
    numbered = own.withColumn("number", F.row_number().over(order)).withColumn("_before", F.lag("event_id").over(order))
    step = F.when(n >= 5, "strong").when(n >= 3, "targeted").otherwise("brief")
    return numbered.select("event_id", "number", step.alias("step"), F.when(step == "targeted", F.col("_before")).alias("last_failure"))


def newest(rows: DataFrame, key: str, seq: str, most: int = 2000) -> DataFrame:
    """The newest row of each key, the `most` newest of these."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    last = rows.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("_row")).select(key, "_row.*")
    return last.orderBy(F.desc(seq), key).limit(most)


def stale_markers(markers: DataFrame, now: Column, current: Column, days: int = 7) -> DataFrame:
    """Markers (session, modified) older than `days`, but for those of the current session."""
    return markers.filter((F.col("modified") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("session") != current))


def most_frequent(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n) of the k most frequent keys, the least of equals first."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def reminders(events: DataFrame, key: str, check: Column, edit: Column, valid_seconds: int = 300, apart_seconds: int = 60) -> DataFrame:
    """(key, event_id) of edits that no check in the time before covers: the first since the last check, each some time after
    the one before it."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = last_before(events, key, check, "_check").withColumn("_island", F.sum(check.cast("int")).over(order))
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_check").cast("timestamp"))
    open_ = marked.filter(edit & (F.col("_check").isNull() | (age > valid_seconds * 1_000_000)))
    first = open_.groupBy(key, "_island").agg(F.min(F.struct("ts", "event_id")).alias("_e")).select(key, "_e.ts", "_e.event_id")
    return spaced(first, [key], apart_seconds).select(key, "event_id")
