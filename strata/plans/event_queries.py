"""Queries over the event table, which stands for a log of tool calls: errors fail, signups check, purchases edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import events as rules
from strata.plans.bindings import table
from strata.plans.registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def kind() -> Column:
    return F.col("event_type")


def _streak_sql(key: str, fresh: str) -> str:
    return f"""WITH m AS (SELECT *, event_type <> 'error' OR coalesce({fresh}, false) AS start FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
    i AS (SELECT *, sum(start::INT) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS island FROM m) SELECT event_id, {key}, row_number() OVER (PARTITION BY {key}, island ORDER BY ts, event_id) AS streak FROM i WHERE event_type = 'error'"""


@query(_streak_sql("user_id", "date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000"))
def failure_streak(spark, sf_dir):
    return rules.failure_streaks(events(spark, sf_dir), "user_id", kind() == "error").select("event_id", "user_id", "streak")


@query(_streak_sql("user_id", "false"))
def command_streak(spark, sf_dir):
    return rules.failure_streaks(events(spark, sf_dir), "user_id", kind() == "error", None).select("event_id", "user_id", "streak")


@query("SELECT event_id, user_id, CASE WHEN nt = 'view' THEN floor(date_diff('microsecond', ts, nts) / 1000) ELSE -1 END::BIGINT AS duration_ms FROM (SELECT *, lead(event_type) OVER w AS nt, lead(ts) OVER w AS nts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click'")
def call_durations(spark, sf_dir):
    return rules.call_durations(events(spark, sf_dir), "user_id", kind() == "click", kind() == "view")


@query("WITH b AS (SELECT *, max(ts) FILTER (event_type = 'signup') OVER w AS c, max(ts) FILTER (event_type = 'purchase') OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, coalesce(c IS NOT NULL AND date_diff('microsecond', c, ts) <= 300000000 AND (e IS NULL OR e <= c), false) AS fresh FROM b")
def verify_freshness(spark, sf_dir):
    return rules.fresh_checks(events(spark, sf_dir), "user_id", kind() == "signup", kind() == "purchase")


def _spaced_sql(where: str, key: str, seconds: int) -> str:
    """Each kept event is the first at least the gap after the one kept before it."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, ts, {key} AS k FROM events WHERE {where}), f AS (SELECT k, min((ts, event_id)) AS p FROM e GROUP BY k),
    r(k, ts, event_id) AS (SELECT k, struct_extract(p, 1), struct_extract(p, 2) FROM f UNION ALL SELECT k, struct_extract(p, 1), struct_extract(p, 2) FROM (SELECT r.k, min((e.ts, e.event_id)) AS p FROM r JOIN e ON e.k = r.k AND date_diff('microsecond', r.ts, e.ts) >= {seconds * 1_000_000} GROUP BY r.k, r.ts, r.event_id)) SELECT k AS {key}, event_id FROM r"""


@query(_spaced_sql("event_type = 'purchase'", "user_id", 300))
def warn_dedup(spark, sf_dir):
    return rules.spaced(events(spark, sf_dir).filter(kind() == "purchase"), ["user_id"], 300)


@query(_spaced_sql("event_type = 'error'", "user_id", 30))
def cooldown_errors(spark, sf_dir):
    return rules.spaced(events(spark, sf_dir).filter(kind() == "error"), ["user_id"], 30)


@query(_spaced_sql("event_type = 'purchase' AND event_id NOT IN (SELECT event_id FROM (SELECT *, max(ts) FILTER (event_type = 'signup') OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE date_diff('microsecond', c, ts) <= 300000000)", "user_id", 60))
def turn_reminder(spark, sf_dir):
    checked = rules.last_before(events(spark, sf_dir), "user_id", kind() == "signup", "c")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("c").cast("timestamp"))
    edits = checked.filter((kind() == "purchase") & (F.col("c").isNull() | (micros > 300_000_000)))
    return rules.spaced(edits, ["user_id"], 60)


@query("SELECT user_id, ts::DATE AS day, count(*) AS commands, count(*) FILTER (event_type = 'error') AS failures, floor(count(*) FILTER (event_type = 'error') * 100 / count(*))::BIGINT AS percent, count(*) FILTER (event_type = 'purchase') AS edits FROM events GROUP BY 1, 2")
def session_summary(spark, sf_dir):
    n, bad = F.count(F.lit(1)), F.count_if(kind() == "error")
    return events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(n.alias("commands"), bad.alias("failures"), F.floor(bad * 100 / n).cast("long").alias("percent"), F.count_if(kind() == "purchase").alias("edits"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 3")
def top_failures(spark, sf_dir):
    return events(spark, sf_dir).filter(kind() == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(3)


@query("SELECT event_id, number FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number FROM events WHERE event_type = 'purchase') WHERE number % 3 = 0")
def nth_edit_alert(spark, sf_dir):
    return rules.every_nth(events(spark, sf_dir).filter(kind() == "purchase"), "user_id").select("event_id", "number")


@query("SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def status_changes(spark, sf_dir):
    return rules.changes_only(events(spark, sf_dir), "user_id", "event_type").select("event_id", "event_type")


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE n <= 50 OR k <= 20")
def tail_retention(spark, sf_dir):
    return rules.tail(events(spark, sf_dir), "user_id", 50, 20).select("event_id")


LEVEL = "CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END"


@query(f"SELECT event_id, max({LEVEL}) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS pending FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)")
def pending_gate(spark, sf_dir):
    return rules.pending(events(spark, sf_dir), "user_id", F.expr(LEVEL), kind() == "signup")


@query("WITH b AS (SELECT *, max(ts) FILTER (event_type = 'signup') OVER w AS c, count(*) FILTER (event_type = 'purchase') OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id FROM b WHERE event_type = 'view' AND n > 0 AND (c IS NULL OR date_diff('microsecond', c, ts) > 300000000)")
def commit_reminder(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rules.last_before(events(spark, sf_dir), "user_id", kind() == "signup", "c").withColumn("n", F.count_if(kind() == "purchase").over(w))
    old = F.col("c").isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("c").cast("timestamp")) > 300_000_000)
    return seen.filter((kind() == "view") & (F.col("n") > 0) & old).select("event_id")


@query("SELECT event_id, CASE WHEN n >= 5 THEN 'strong' WHEN n >= 3 THEN 'targeted' ELSE 'brief' END AS step FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')")
def failure_ladder(spark, sf_dir):
    n = F.col("number")
    counted = rules.every_nth(events(spark, sf_dir).filter(kind() == "error"), "user_id", 1)
    return counted.select("event_id", F.when(n >= 5, "strong").when(n >= 3, "targeted").otherwise("brief").alias("step"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'impact' WHEN event_type = 'error' THEN 'verify' WHEN event_type = 'view' AND value > 50 THEN 'lookup' ELSE 'none' END AS hint FROM events")
def hint_class(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.when(kind() == "purchase", "impact").when(kind() == "error", "verify").when((kind() == "view") & (F.col("value") > 50), "lookup").otherwise("none").alias("hint"))


@query("SELECT event_type AS tool, user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def tool_usage(spark, sf_dir):
    return events(spark, sf_dir).filter(kind() != "error").groupBy(kind().alias("tool"), "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i AS attempt, least(pow(2, i) * 1000, 60000)::BIGINT AS wait_ms FROM range(12) t(i)")
def restart_backoff(spark, sf_dir):
    return spark.range(12).select(F.col("id").alias("attempt"), F.least(F.pow(F.lit(2.0), "id") * 1000, F.lit(60000.0)).cast("long").alias("wait_ms"))


@query(_streak_sql("user_id", "date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000"))
def stream_failure_streak(spark, sf_dir):
    """The live form over the event file as a stream, read to its end; its rows must be those of the batch form."""
    import uuid

    from strata.scratch import scratch_root
    from strata.streaming.rules import failure_streaks

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")
    live = failure_streaks(stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (kind() == "error").alias("failed")), "user_id", forget=False).select("event_id", "user_id", "streak")
    path = f"{scratch_root(spark)}/streaks-{uuid.uuid4().hex}"
    running = live.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
    return spark.read.schema(live.schema).parquet(f"{path}/rows")
