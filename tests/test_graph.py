import pytest
from pyspark.sql import functions as F

from strata.operators import graph, joins


def edges(spark, rows):
    return spark.createDataFrame([(*r, "call") for r in rows], "source string, target string, weight double, kind string")


def ranks(spark, nodes, rows, **more):
    df = spark.createDataFrame([(n,) for n in nodes], "id string")
    return {r.id: r.pagerank for r in graph.pagerank(df, edges(spark, rows), **more).collect()}


def test_no_nodes_one_node_and_no_edges(spark):
    assert ranks(spark, [], []) == {}
    assert ranks(spark, ["a"], []) == {"a": 1.0}
    assert all(abs(x - 0.25) < 1e-9 for x in ranks(spark, "abcd", []).values())


def test_ranks_sum_to_one_with_dangling_nodes_and_lost_mass(spark):
    found = ranks(spark, "abc", [("a", "b", 0.5), ("b", "elsewhere", 1.0)])
    assert abs(sum(found.values()) - 1) < 1e-9 and all(x > 0 for x in found.values()) and found["b"] > found["a"]


def test_a_ring_is_even_and_settles(spark):
    found = ranks(spark, "abcde", [(x, y, 1.0) for x, y in zip("abcde", "bcdea")])
    assert all(abs(x - 0.2) < 1e-6 for x in found.values())


def test_reach_stops_at_blocked_nodes_and_depth(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "x", 1.0), ("x", "y", 1.0)])
    seed, stop = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("x",)], "id string")
    assert {(r.id, r.level) for r in graph.reach(e, seed, 2, "out", stop).collect()} == {("b", 1), ("c", 2)}
    assert {(r.id, r.level) for r in graph.reach(e, spark.createDataFrame([("d",)], "id string"), 9, "in").collect()} == {("c", 1), ("b", 2), ("a", 3)}


def test_only_direct_importers_depend(spark):
    imports = spark.createDataFrame([("app", "lib"), ("lib", "math")], "file string, target string")
    assert {r.file for r in joins.dependents(imports, spark.createDataFrame([("math",)], "file string")).collect()} == {"math", "lib"}


def test_nearest_paths_by_brute_force(spark):
    known = ["core/graph.ts", "core/graphs.ts", "a", "ab", "tools/x.py", "core/rank.ts"]
    asked = ["core/grahp.ts", "core/grph.ts", "b", "tools/x.pyy", "nothing/like/it", "core/gaphs.ts"]

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for q in asked:
        d, p = min((edit(q, k), k) for k in known)
        if d <= 3:
            want[q] = (p, d)
    got = joins.nearest_paths(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(k,) for k in known], "file string"))
    assert {r["query"]: (r.path, r.distance) for r in got.collect()} == want


def test_provenance_is_part_of_an_edge(spark):
    a = spark.createDataFrame([("x", "y", "heuristic")], "source string, target string, provenance string")
    found = graph.edge_diff(a, a.withColumn("provenance", F.lit("resolved")), a.columns).collect()
    assert {(r.provenance, r.change_type) for r in found} == {("heuristic", "removed"), ("resolved", "added")}


@pytest.mark.parametrize(("kind", "name", "file", "kept"), [("function", "helper", "a.ts", True), ("interface", "I", "a.ts", False), ("function", "main", "a.ts", False), ("function", "x", "a.test.ts", False), ("function", "App", "a.tsx", False), ("function", "handle_x", "a.py", False)])
def test_orphan_rules(spark, kind, name, file, kept):
    own = spark.createDataFrame([("i", name, kind, file, "public")], "id string, name string, kind string, file string, visibility string")
    none = spark.createDataFrame([], "file string, name string")
    assert joins.orphans(own, edges(spark, []), none).count() == int(kept)
