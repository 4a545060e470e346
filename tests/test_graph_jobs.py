import itertools
import random

import pytest
from pyspark.sql import functions as F

from edgewise.operators import edges as E, paths, rank, triangles

# fixed input: the eight directed edges of the sample follower graph
FOLLOWS = [(2, 1), (4, 1), (1, 2), (6, 3), (7, 3), (7, 6), (6, 7), (3, 7)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def test_pagerank_with_drop_out(spark):
    ranks = rank.pagerank(frame(spark, FOLLOWS), 10, keep_all=False).state.collect()
    found = {r["node"]: round(r["rank"], 6) for r in ranks}
    assert found == {1: 1.0, 2: 1.196874, 3: 1.0, 6: 0.701812, 7: 1.298188}


def test_pagerank_link_pairs(spark):
    pairs = [(1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 1)]
    found = {r["node"]: r["rank"] for r in rank.pagerank(frame(spark, pairs), 10).state.collect()}
    assert found[1] == pytest.approx(1.738007, abs=1e-6)
    assert found[2] == found[3] == found[4] == pytest.approx(0.753998, abs=1e-6)


def test_pagerank_to_tolerance_and_hot_source(spark, hot_keys):
    pairs = [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(1, 30)]
    loop = rank.pagerank(frame(spark, pairs), rounds=200, tol=1e-4)
    assert loop.converged and loop.iterations < 200
    found = {r["node"]: r["rank"] for r in loop.state.collect()}
    assert sum(found.values()) == pytest.approx(30, abs=1e-2)
    assert rank.top(loop.state, 1).first()["node"] == 0


def brute_triangles(pairs):
    edges = {frozenset(p) for p in pairs if p[0] != p[1]}
    nodes = sorted({x for p in pairs for x in p})
    counts = dict.fromkeys(nodes, 0)
    for a, b, c in itertools.combinations(nodes, 3):
        if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= edges:
            for x in (a, b, c):
                counts[x] += 1
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles(spark, hot_keys, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(15), rng.randrange(15)) for _ in range(50)] + [(0, i) for i in range(15)]
    found = triangles.triangles_per_vertex(frame(spark, pairs)).collect()
    want = brute_triangles(pairs)
    assert {r["node"]: r["n_triangles"] for r in found} == want
    total = triangles.triangles_total(frame(spark, pairs)).first()["n_triangles"]
    assert total == sum(want.values()) // 3


@pytest.mark.parametrize("kind", [int, str])
def test_triangles_in_many_colours(spark, monkeypatch, kind):
    """An edge goes to few tasks, whatever the degrees: no row carries the list of a neighbour."""
    monkeypatch.setattr(triangles, "TASK_EDGES", 20)
    monkeypatch.setattr(triangles, "PATHS", 7)
    rng = random.Random(3)
    pairs = [(kind(rng.randrange(20)), kind(rng.randrange(20))) for _ in range(120)] + [(kind(0), kind(i)) for i in range(25)]
    rows = spark.createDataFrame(pairs, "src string, dst string" if kind is str else "src long, dst long")
    found = triangles.triangles_per_vertex(rows)
    want = brute_triangles(pairs)
    assert {r["node"]: r["n_triangles"] for r in found.collect()} == want
    assert triangles.triangles_total(rows).first()["n_triangles"] == sum(want.values()) // 3
    assert set(triangles.triangle_corners(rows).columns) == {"node", "n"}
    assert triangles.triangles_total(rows.limit(0)).first()["n_triangles"] == 0


def test_shortest_paths(spark, hot_keys):
    rows = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (4, 0, 1.0), (0, 1, 9.0)]
    rows += [(0, 10 + i, 1.0) for i in range(12)]
    edges = spark.createDataFrame(rows, "src bigint, dst bigint, weight double")
    sources = spark.createDataFrame([(0,)], "node bigint")
    loop = paths.shortest_paths(edges, sources)
    found = {r["node"]: r["distance"] for r in loop.state.collect()}
    assert loop.converged
    assert {n: found[n] for n in range(5)} == {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0, 4: float("inf")}


def test_transitive_closure(spark, hot_keys):
    loop = paths.transitive_closure(frame(spark, FOLLOWS))
    pairs = {(r["src"], r["dst"]) for r in loop.state.collect()}
    assert loop.converged and len(pairs) == 15
    assert {(4, 1), (4, 2), (1, 1), (2, 2), (3, 6)} <= pairs and (1, 4) not in pairs


def test_degree_histogram(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 5)], "node bigint")
    hist = E.degree_histogram(frame(spark, [(1, 2), (2, 1), (1, 3)]), nodes).collect()
    assert {r["degree"]: r["n_nodes"] for r in hist} == {0: 1, 1: 2, 2: 1}


def test_adjacency(spark):
    rows = E.adjacency(frame(spark, [(1, 2), (3, 1), (1, 2)])).where(F.col("node") == 1).collect()
    assert rows == [(1, [2, 3])]


def test_paths_without_edges_and_many_rounds(spark):
    """A long path: distances are merged on the way; a source that is no node is not told."""
    from edgewise.operators import paths

    n = 40
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)] + [(0, 30, 50.0), (None, 3, 1.0)], "src long, dst long, weight double")
    start = spark.createDataFrame([(0,), (777,)], "node long")
    loop = paths.shortest_paths(edges, start)
    assert {r["node"]: r["distance"] for r in loop.state.collect()} == {i: float(i) for i in range(n + 1)}
    assert loop.converged and loop.changes[-1] == 0 and not paths.shortest_paths(edges, start, max_iters=3).converged
    assert paths.shortest_paths(edges.limit(0), start).state.count() == 0
    closure = paths.transitive_closure(edges.select("src", "dst").where("src < 12"))
    assert closure.state.where("dst <= 12").count() == 12 * 13 // 2 and closure.state.where("dst = 30").count() == 1
    assert closure.state.distinct().count() == closure.state.count()


def test_pairs_of_the_power_iteration_lie_by_source_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """The planner put small tasks together, so that few of any size were left, each with all nodes."""
    from edgewise.catalog import graph_jobs
    from edgewise.catalog.registry import QUERIES

    pairs = spark.range(3000).selectExpr("id % 300 as src", "1000 + id % 7 as dst").groupBy("src", "dst").count()
    rows = pairs.collect()
    assert graph_jobs._by_source(pairs, 3000) is pairs
    monkeypatch.setattr(graph_jobs, "PAIR_ROWS", 100)
    dealt = graph_jobs._by_source(pairs, 3000)
    placed = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert dealt.rdd.getNumPartitions() == 30
    assert sorted(tuple(r)[:3] for r in placed) == sorted(map(tuple, rows))
    assert len({(r["src"], r["task"]) for r in placed}) == 300

    lines = spark.range(400).selectExpr("id % 40 as l_partkey", "id % 9 as l_suppkey")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = [r["node"] for r in QUERIES["pic"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted([2 * i for i in range(40)] + [2 * i + 1 for i in range(9)])
