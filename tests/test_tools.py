import datetime

import pytest
from pyspark.sql import functions as F

from strata.functions import paths, shell
from strata.functions import text as texts
from strata.operators import events, graph, joins
from strata.scratch import cut, once
from strata.sources import cache
from strata.streaming import rules


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("a b | c; d && e || f", [["a", "b"], ["c"], ["d"], ["e"], ["f"]]),
        ("git commit -m 'x; y | z'", [["git", "commit", "-m", "x; y | z"]]),
        ('echo "a \\" b" $(date; ls | wc)', [["echo", 'a " b', "$(date; ls | wc)"]]),
        ("echo pre$(f (g) ')')post", [["echo", "pre", "$(f (g) ')')", "post"]]),
        ("a\\ b c", [["a b", "c"]]),
        ("echo 'it'\\''s'", [["echo", "it's"]]),
        (" ; | ", []), ("", []), (None, []), ("echo 'open", [["echo", "ope"]]),
    ],
)
def test_segments(command, want):
    assert shell.segments(command) == want


def test_a_kept_graph_comes_back_without_loose_edges(spark, tmp_path):
    s = spark.createDataFrame([(x, x, "function", "f", 1, 2, "public") for x in "abc"], cache.SYMBOLS)
    e = spark.createDataFrame([("a", "b", "call", 1.0, 0.9, "resolved"), ("b", "x", "call", 1.0, 0.9, "resolved"), ("x", "a", "call", 1.0, 0.9, "resolved")], cache.EDGES)
    path = str(tmp_path / "graph")
    assert cache.load(spark, path) is None
    cache.save(s, e, path)
    symbols, edges = cache.load(spark, path)
    assert symbols.count() == 3 and [tuple(r)[:2] for r in edges.select("source", "target").collect()] == [("a", "b")]
    assert cache.load(spark, path, version=2) is None and cache.load(spark, path, hours=0) is None
    cache.save(s.drop("name"), e, path)
    assert cache.load(spark, path) is None
    text = spark.createDataFrame([('{"source":"a","target":"c","kind":"call","weight":1.0}',), ("junk",), ('{"source":"a"}',)], "text string")
    assert [(r.target, r.confidence, r.provenance) for r in cache.edges_from_json(text, s).collect()] == [("c", 1.0, "heuristic")]
    again = cache.unpacked(cache.packed(e))
    assert sorted(map(tuple, again.collect())) == sorted((r.source, r.target, r.kind, r.weight) for r in e.collect())


def test_an_older_graph_is_upgraded(spark, tmp_path):
    s = spark.createDataFrame([(x, x, "function", "f", 1, 2, "public") for x in "ab"], cache.SYMBOLS)
    old = spark.createDataFrame([("a", "b", "call", 1.0)], "source string, target string, kind string, weight double")
    assert not cache.upgrade(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    cache.save(s, old, str(tmp_path / "old"), version=0)
    assert cache.load(spark, str(tmp_path / "old")) is None and cache.upgrade(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert [tuple(r) for r in cache.load(spark, str(tmp_path / "new"))[1].select("confidence", "provenance").collect()] == [(1.0, "heuristic")]


def test_a_refresh_is_a_full_build(spark):
    """After files are changed, added and deleted the edges are those of all facts anew."""
    s = [("a1", "a1", "a"), ("a2", "a2", "a"), ("b1", "b1", "b"), ("c1", "c1", "c"), ("d1", "d1", "d")]
    symbols = spark.createDataFrame(s, "id string, name string, file string")
    before = [("a1", "b1", "a"), ("b1", "c1", "b"), ("c1", "a2", "c"), ("d1", "a1", "d"), ("d1", "c1", "d")]
    after = [("a1", "b1", "a"), ("b1", "a1", "b"), ("b1", "d1", "b"), ("c1", "a2", "c"), ("d1", "c1", "d")]
    facts = lambda rows: spark.createDataFrame(rows, "source string, name string, file string")
    build = lambda rows: joins.name_edges(rows.select("source", "name"), symbols, "call", 1.0, 0.9)
    changed, imports = spark.createDataFrame([("b",), ("a",)], "file string"), spark.createDataFrame([("d", "a")], "file string, target string")
    got = joins.refreshed_edges(build(facts(before)), symbols, changed, imports, lambda files: build(facts(after).join(files, "file", "left_semi")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(facts(after)).collect()))


def test_intermediate_tables_are_made_once_and_anew_for_new_input(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "in"))

    spark.range(3).write.parquet(str(tmp_path / "in"))
    sources = [str(tmp_path / "in")]
    assert once(spark, "t", sources, build).count() == once(spark, "t", sources, build).count() == 3 and len(made) == 1
    import time

    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert once(spark, "t", sources, build).count() == 5
    assert "ExistingRDD" not in cut(spark.range(2))._jdf.queryExecution().toString()


def test_spaced_by_the_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(k, rng.randrange(5), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(4000))) for k in range(400)]
    got = {(r.user_id, r.event_id) for r in events.spaced(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), ["user_id"], 60).collect()}
    want = set()
    for user in range(5):
        last = None
        for ts, event in sorted((t, e) for e, u, t in rows if u == user):
            if last is None or (ts - last).total_seconds() >= 60:
                want.add((user, event))
                last = ts
    assert got == want


def test_paths_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(paths.file_uri(lit("/a b/ü.ts"))) == "file:///a%20b/%C3%BC.ts" and one(paths.uri_path(lit("file:///a%20b/%C3%BC.ts"))) == "/a b/ü.ts"
    assert one(paths.file_uri(lit("C:\\x\\y.ts"))) == "file:///C:/x/y.ts" and one(paths.uri_path(lit("file:///C:/x/y.ts"))) == "C:/x/y.ts" and one(paths.uri_path(lit("/plain"))) == "/plain"
    assert one(paths.ancestors(lit("a/b/c.ts"))) == ["a/b", "a", "."] and one(paths.ancestors(lit("c.ts"))) == ["."]
    assert one(texts.report_passed(lit(None).cast("string"))) is False
    assert one(texts.test_summary(lit("x\n" * 29 + "PASS"))) == "x x x x PASS" and one(texts.test_summary(lit("PASS"))) is None
    assert one(texts.compact_diagnostic(lit("a.TS"), lit(1), lit(2), lit("info"), lit(""), lit("m"))) == "a.TS:1:2  INF  m (typescript)"
    assert one(texts.command_key(lit("timeout 5 cat /tmp/a"))) == one(texts.command_key(lit("timeout 77  cat /tmp/b.c ")))


def test_the_chart_says_what_it_leaves_out(spark):
    rows = spark.createDataFrame([(f"t{k:02}", k % 4) for k in range(40)], "target string, p int")
    lines = graph.mermaid(rows, "a::b").first().mermaid.split("\n")
    assert len(lines) == 31 and lines[0] == "flowchart TD" and lines[-1] == "%% 11 more" and lines[1:5] == ["  a__b --> t00", "  a__b -.-> t01", "  a__b --> t02", "  a__b -.-> t03"]


def _live(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def _end(df, tmp_path, spark):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_a_live_warning_comes_once(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(at, "a"), (at, "a"), (at + datetime.timedelta(minutes=1), "a"), (at, "b")]
    found = _end(rules.warn_once(_live(spark, tmp_path, "in", rows, "ts timestamp, file string"), ["file"]), tmp_path, spark)
    assert sorted(r.file for r in found.collect()) == ["a", "b"]


def test_live_calls_meet_their_results(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    calls = _live(spark, tmp_path, "calls", [("x", at), ("y", at), ("z", at)], "call_id string, ts timestamp")
    results = _live(spark, tmp_path, "results", [("x", at + datetime.timedelta(seconds=2)), ("y", at + datetime.timedelta(minutes=30)), ("z", at - datetime.timedelta(seconds=1))], "call_id string, ts timestamp")
    assert [(r.call_id, r.duration_ms) for r in _end(rules.call_results(calls, results), tmp_path, spark).collect()] == [("x", 2000)]
