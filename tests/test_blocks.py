import re

import pytest
from pyspark.sql import functions as F

from strata.operators import graph, joins, texts
from strata.plans import bindings, graph_queries
from strata.plans.queries import QUERIES
from strata.sources import cache

EDGE = "source string, target string, kind string, weight double, confidence double, provenance_rank int"


@pytest.fixture(scope="module")
def mixed(spark):
    """Symbols, plain edges, blocks, and all edges one by one."""
    own = spark.createDataFrame([(x, f"n{x}", f"{x}.ts", k) for k, x in enumerate("abcdefgh")], "id string, name string, file string, line int")
    plain = spark.createDataFrame([("a", "p", "call", 1.0, 0.9, 0), ("b", "c", "call", 1.0, 0.9, 1), ("e", "a", "type", 0.4, 0.8, 2), ("f", "g", "call", 1.0, 0.9, 0)], EDGE)
    sources = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("h", "2"), ("x", "1"), ("a", "3")], "source string, block string")
    targets = spark.createDataFrame([("d", "1"), ("e", "1"), ("f", "2"), ("y", "2"), ("g", "4")], "target string, block string")
    blocks = graph.Blocks(sources, targets, "import", 0.3, 0.5, 2)
    return own, plain, blocks, plain.unionByName(blocks.edges())


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_blocks_give_what_their_edges_give(spark, mixed):
    own, plain, blocks, whole = mixed
    ids = spark.createDataFrame([("b",), ("e",), ("h",)], "id string")
    assert whole.count() == 4 + 3 * 2 + 2 * 2 == whole.distinct().count()
    assert rows(graph.degrees(plain, blocks)) == rows(graph.degrees(whole))
    assert rows(graph.kind_counts(plain, blocks).withColumn("weight", F.round("weight", 9))) == rows(graph.kind_counts(whole).withColumn("weight", F.round("weight", 9)))
    for way, near in (("out", "source"), ("in", "target")):
        assert rows(graph.reach(plain, ids, 3, way, blocks=blocks)) == rows(graph.reach(whole, ids, 3, way))
        assert rows(graph.call_chain(plain, "e", 3, way, blocks)) == rows(graph.call_chain(whole, "e", 3, way))
        assert rows(graph.edges_of(plain, ids, near, blocks)) == rows(graph.edges_of(whole, ids, near))
    names = own.filter("id in ('a', 'd')").select("name")
    assert rows(graph.flat_references(own, plain, names, blocks)) == rows(graph.flat_references(own, whole, names))
    assert len(graph.edges_of(plain, ids, "source", blocks, 1).filter("kind = 'import'").collect()) == 3


def test_ranks_over_blocks_are_those_over_their_edges(mixed):
    own, plain, blocks, whole = mixed
    got, want = ({r.id: r.pagerank for r in graph.pagerank(own, e, rounds=20, tolerance=0, blocks=b).collect()} for e, b in ((plain, blocks), (whole, None)))
    assert abs(sum(got.values()) - 1) < 1e-9 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_a_kept_graph_keeps_its_products(spark, mixed, tmp_path):
    own, plain, blocks, whole = mixed
    own = own.selectExpr("id", "name", "'function' AS kind", "file", "bigint(line) AS line", "bigint(line) AS end_line", "'public' AS visibility")
    named = lambda e: e.drop("provenance_rank").withColumn("provenance", F.lit("heuristic"))
    sources = blocks.sources.selectExpr("*", "'import' AS kind", "0.3D AS weight", "0.5D AS confidence", "'heuristic' AS provenance")
    cache.save(own, named(plain), f"file://{tmp_path}/g", products=(sources, blocks.targets))
    assert rows(cache.load(spark, f"file://{tmp_path}/g")[1]) == rows(cache.connected(named(whole), own))


def graph_tables(spark, folder, customers, suppliers):
    """The graph's tables with customers and suppliers of (key, nation), and two lines of an order."""
    text = lambda c, v: F.lit(v).alias(c)
    customers.select(F.col("k").alias("c_custkey"), F.concat(F.lit("C"), "k").alias("c_name"), F.col("n").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), text("c_mktsegment", "M")).write.parquet(f"{folder}/customer.parquet")
    suppliers.select(F.col("k").alias("s_suppkey"), F.concat(F.lit("S"), "k").alias("s_name"), F.col("n").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")
    for name, ddl, values in (
        ("nation", "n_nationkey int, n_name string, n_regionkey int", [(1, "N", 1), (2, "O", 1)]), ("region", "r_regionkey int, r_name string", [(1, "R")]),
        ("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(11, "p", "Brand#11", "T", 3, 1.0)]),
        ("orders", "o_orderkey long, o_custkey long", [(1, 7)]),
        ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp_ntz", [(1, 11, 1, "A", None), (1, 11, 1, "R", None)]),
    ):
        spark.createDataFrame(values, ddl).write.parquet(f"{folder}/{name}.parquet")


def test_an_edge_is_one_row_where_keys_repeat_and_nations_are_null(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    pairs = lambda *rows: spark.createDataFrame(rows, "k long, n int")
    graph_tables(spark, folder, pairs((7, 1), (7, 2), (7, 1), (8, 2), (9, None)), pairs((1, 1), (1, 2), (2, 2), (3, None), (2, 2)))
    raw = bindings.raw_edges(spark, folder)
    keys = [c for c in raw.columns if c not in ("provenance_rank", "shipped")]
    assert rows(bindings.edges(spark, folder)) == rows(raw.groupBy(*keys).agg(F.min("provenance_rank").alias("provenance_rank")))


def test_a_product_too_large_to_write_is_counted_and_ranked(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    many = spark.range(60_000).select(F.col("id").alias("k"), F.lit(1).alias("n"))
    graph_tables(spark, folder, many, many)
    assert QUERIES["graph_summary"](spark, folder).first().n_edges == 60_000**2 + 2
    assert {r.kind: r.n for r in QUERIES["enum_codecs"](spark, folder).collect()} == {"call": 1, "type": 1, "import": 60_000**2}
    assert abs(QUERIES["pagerank_fixed"](spark, folder).agg(F.sum("pagerank")).first()[0] - 1) < 1e-3
    assert QUERIES["blast_radius_down"](spark, folder).count() == 60_001
    assert QUERIES["mermaid_text"](spark, folder).first().mermaid.count("\n") == 29


def test_spans_of_all_lengths_by_brute_force(spark):
    spans = [(f"s{k}", "ab"[k % 2], a, a + w) for k, (a, w) in enumerate([(0, 0), (1, 1), (3, 4), (-7, 9), (5, 1000), (6, 63), (6, 64), (8, -1), (990, 40), (1 << 40, 1 << 41)])]
    sites = [(f, at) for f in "abc" for at in (-8, -7, -1, 0, 1, 2, 3, 7, 8, 69, 70, 71, 1000, 1005, 1006, 1 << 41)]
    got = joins.within_spans(spark.createDataFrame(spans, "id string, file string, line long, end_line long"), spark.createDataFrame(sites, "file string, site long"), "site").collect()
    assert sorted((r.id, r.site) for r in got) == sorted((i, at) for i, f, a, b in spans for g, at in sites if f == g and a <= at <= b)


def test_complexity_of_a_file_of_very_many_spans(spark):
    spans = spark.range(400_000).selectExpr("string(id) AS id", "'one' AS file", "id * 3 AS line", "id * 3 + 2 AS end_line")
    branches = spark.range(400_000).selectExpr("'one' AS file", "'if' AS kind", "false AS has_if_child", "id * 3 AS start_row", "id * 3 + 1 + (id % 3) AS end_row")
    found = texts.branch_complexity(spans, branches).groupBy("complexity").count().collect()
    assert {r.complexity: r["count"] for r in found} == {2: 266_667, 1: 133_333}


def test_impact_writes_no_edges(spark, tmp_path, monkeypatch):
    """What is asked of some files' symbols is found without the table of all edges, and is what that table gives."""
    folder = f"file://{tmp_path}/t"
    pairs = lambda *rows: spark.createDataFrame(rows, "k long, n int")
    graph_tables(spark, folder, pairs((7, 1), (8, 2)), pairs((1, 1), (2, 2)))
    monkeypatch.setattr(graph_queries, "FILE", "catalog/Brand_11/")
    want = graph.impact(bindings.symbols(spark, folder), bindings.edges(spark, folder), bindings.symbols(spark, folder).filter("id = 'part::11'").select("file"), 1, F.lit(False))
    monkeypatch.setattr(bindings, "once", None)  # fails where anything is written once
    assert rows(graph_queries._impact(spark, folder)) == rows(want) and want.count() == 2
    ids = spark.range(-9, 40).withColumn("name", bindings.named("id"))
    assert all(r.name == f"{bindings.PREFIXES[r.id % 3]}{r.id // 3}" for r in ids.collect())


def test_identities_are_those_of_grouped_edges_and_nothing_is_grouped(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    pairs = lambda *rows: spark.createDataFrame(rows, "k long, n int")
    graph_tables(spark, folder, pairs((7, 1), (7, 2), (7, 1), (8, 2), (9, None)), pairs((1, 1), (1, 2), (2, 2), (3, None), (2, 2), (None, 2)))
    named = F.expr("concat_ws('::', source, target, kind, int(round(weight)), int(round(confidence * 10)), element_at(array('resolved', 'name_match', 'heuristic'), provenance_rank + 1))")
    want = bindings.edges(spark, folder).groupBy("source", "target", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(named)), ",").alias("identity"))
    got = QUERIES["edge_identity"](spark, folder)
    assert rows(got) == rows(want) and got.filter("n = 1 AND identity <> ''").count() == want.count() == 2 + 2 * 3
    assert not re.search(r"Aggregate \[source#\d+, target#\d+", got._jdf.queryExecution().optimizedPlan().toString())


def test_pairs_of_blocks_are_their_edges(spark, mixed):
    blocks = mixed[2]
    assert rows(blocks.pairs(blocks.sources, blocks.targets, 2)) == rows(blocks.edges().select("source", "target"))


def test_a_kept_graph_has_the_edges_that_can_be_read_back_and_an_older_one_is_asked(spark, mixed, tmp_path):
    own, plain, blocks, whole = mixed
    path = f"file://{tmp_path}/g"
    own = own.selectExpr("id", "name", "'function' AS kind", "file", "bigint(line) AS line", "bigint(line) AS end_line", "'public' AS visibility")
    named = lambda e: e.drop("provenance_rank").withColumn("provenance", F.lit("heuristic"))
    sources = blocks.sources.selectExpr("*", "'import' AS kind", "0.3D AS weight", "0.5D AS confidence", "'heuristic' AS provenance")
    cache.save(own, named(plain), path, products=(sources, blocks.targets))
    want = rows(cache.connected(named(whole), own))
    assert rows(spark.read.parquet(f"{path}/edges")) == rows(cache.connected(named(plain), own)) and rows(cache.load(spark, path)[1]) == want
    assert not {r.source for r in spark.read.parquet(f"{path}/sources").collect()} & {"x"} and not {r.target for r in spark.read.parquet(f"{path}/targets").collect()} & {"y"}
    for name, rest in (("edges", named(plain)), ("sources", sources), ("targets", blocks.targets), ("meta", spark.sql("SELECT 1 AS version, current_timestamp() AS saved"))):
        rest.write.mode("overwrite").parquet(f"{path}/{name}")
    assert rows(cache.load(spark, path)[1]) == want


def test_a_graph_is_kept_without_grouping_calls_from_elsewhere(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    pairs = lambda *rows: spark.createDataFrame(rows, "k long, n int")
    graph_tables(spark, folder, pairs((7, 1), (8, 2)), pairs((1, 1), (2, 2)))
    spark.createDataFrame([(1, 11, 1, "A", None), (1, 11, 1, "R", None), (2, 11, 2, "N", None), (1, 12, 1, "A", None), (1, 11, 9, "A", None), (1, None, 1, "A", None)], "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp_ntz").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    every = bindings.symbols(spark, folder)
    named = lambda e: e.withColumn("provenance_rank", F.col("provenance_rank").cast("int"))
    assert rows(named(bindings.stored_among(spark, folder, every))) == rows(named(cache.connected(bindings.stored(spark, folder), every)))
    once = bindings.once
    monkeypatch.setattr(bindings, "once", lambda spark, name, *rest: once(spark, name, *rest) if name == "types" else pytest.fail(name))
    got = QUERIES["graph_cache"](spark, folder)
    assert [tuple(r) for r in got.orderBy("target").collect()] == [("part::11", "supp::1", "type", 0.4, 0.8, "resolved"), ("part::11", "supp::2", "type", 0.4, 0.8, "heuristic")]
