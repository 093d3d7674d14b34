import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from strata.operators import events as rules
from strata.streaming import rules as live

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user string, kind string"


def log(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(seconds=s), u, kind) for k, (s, u, kind) in enumerate(rows)], SCHEMA)


def test_streaks_reset_on_success_and_after_the_ttl(spark):
    df = log(spark, [(0, "a", "bad"), (1, "a", "bad"), (2, "a", "ok"), (3, "a", "bad"), (5000, "a", "bad"), (1, "b", "bad")])
    got = {r.event_id: r.streak for r in rules.failure_streaks(df, "user", F.col("kind") == "bad").collect()}
    assert got == {0: 1, 1: 2, 3: 1, 4: 1, 5: 1}


def test_spaced_is_a_fold(spark):
    df = log(spark, [(s, "a", "x") for s in (0, 20, 40, 59, 61, 119, 130)])
    assert {r.event_id for r in rules.spaced(df, ["user"], 60).collect()} == {0, 4, 6}


def test_freshness_ends_with_time_or_an_edit(spark):
    df = log(spark, [(0, "a", "check"), (10, "a", "look"), (20, "a", "edit"), (30, "a", "look"), (40, "a", "check"), (400, "a", "look")])
    got = {r.event_id: r.fresh for r in rules.fresh_checks(df, "user", F.col("kind") == "check", F.col("kind") == "edit").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}


def test_the_live_form_agrees_with_the_batch_form(spark, tmp_path):
    df = log(spark, [(s * 7 % 97 + s, "ab"[s % 2], "bad" if s % 5 else "ok") for s in range(60)])
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    stream = stream.select("user", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("kind") == "bad").alias("failed"))
    running = live.failure_streaks(stream, "user", forget=False).writeStream.format("memory").queryName("live_streaks").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination(60)
    want = {(r.event_id, r.streak) for r in rules.failure_streaks(df, "user", F.col("kind") == "bad").collect()}
    assert {(r.event_id, r.streak) for r in spark.table("live_streaks").collect()} == want


@pytest.mark.parametrize("name", ["graph_edges", "orphans", "innermost_symbol", "failure_streak", "redact_text", "snapshot_diff", "fuzzy_path", "verify_verdict"])
def test_queries_agree_with_their_oracles(spark, name):
    import os

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    found = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
