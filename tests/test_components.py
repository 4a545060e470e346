import random

import numpy as np
import pytest

from edgewise.operators import components as C, edges as E
from edgewise.operators.property_graph import PropertyGraph

ALGORITHMS = ["star", "rewrite", "hooking", "minlabel", "selfmsg"]


def frame(spark, pairs, kind="bigint"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def labels(result):
    rows = result.labels.collect()
    found = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(found), "one row per node"
    return found


def mixed_graph(seed):
    """Random edges, a hub, a path, a cycle, self loops, duplicates, reversed edges, nulls."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    pairs += [(200, i) for i in range(201, 240)]
    pairs += [(300 + i, 301 + i) for i in range(6)]
    pairs += [(400, 401), (401, 402), (402, 400), (500, 500)]
    pairs += [(b, a) for a, b in pairs[:10]] + pairs[:5] + [(None, 3), (4, None)]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_agrees_with_union_find(spark, algorithm):
    pairs = mixed_graph(1)
    result = C.connected_components(frame(spark, pairs), algorithm)
    assert result.converged
    assert result.changes[-1] == 0
    assert len(result.changes) == result.iterations
    assert labels(result) == union_find(pairs)
    result.release()


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_hot_keys_give_the_same_labels(spark, hot_keys, algorithm):
    pairs = mixed_graph(2)
    assert labels(C.connected_components(frame(spark, pairs), algorithm)) == union_find(pairs)


def test_round_counts_of_a_long_path(spark):
    path = frame(spark, [(i, i + 1) for i in range(299)])
    star = C.connected_components(path, "star")
    assert star.converged and star.iterations == 10
    assert set(labels(star).values()) == {0}
    capped = C.connected_components(path, "minlabel", max_iters=3)
    assert not capped.converged and capped.iterations == 3
    assert len(labels(capped)) == 300


def test_many_edges_are_made_stars_before_the_rounds(spark, monkeypatch):
    """Every edge of the input went through the sorts of the first rounds."""
    monkeypatch.setattr(C, "MIN_CHUNKED", 50)
    monkeypatch.setattr(C, "CHUNK_ROWS", 40)
    pairs = mixed_graph(3) + [(1000 + i, 1001 + i) for i in range(99)] * 4
    taken = []
    monkeypatch.setattr(C, "iterate", lambda scratch, start, *a, n, f=C.iterate, **k: taken.append((start.df.count(), n)) or f(scratch, start, *a, n=n, **k))
    result = C.connected_components(frame(spark, pairs), "star")
    assert labels(result) == union_find(pairs)
    before = sum(1 for a, b in pairs if a is not None and b is not None and a != b)
    assert taken[0][0] == taken[0][1] < before
    # other ids take the plain way
    names = [(str(a), str(b)) for a, b in pairs if a is not None and b is not None]
    assert labels(C.connected_components(frame(spark, names, "string"), "star")) == union_find(names)


def test_stars_of_a_chunk():
    hi, lo = C._chunk_star(np.array([5, 9, 9, 2, 7]), np.array([3, 5, 5, 1, 3]))
    assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {5: 3, 9: 3, 7: 3, 2: 1}


def test_hooking_cap_still_gives_one_row_per_node(spark):
    path = frame(spark, [(i, i + 1) for i in range(30)])
    capped = C.connected_components(path, "hooking", max_iters=3)
    assert not capped.converged
    assert len(labels(capped)) == 31


def test_string_ids_compare_as_text(spark):
    pairs = [("A", "B"), ("B", "C"), ("C", "D"), ("E", "F"), ("10", "9")]
    result = C.connected_components(frame(spark, pairs, "string"), "minlabel")
    assert labels(result) == {**dict.fromkeys("ABCD", "A"), **dict.fromkeys("EF", "E"), "10": "10", "9": "10"}


def test_isolated_vertices_and_empty_graph(spark):
    nodes = spark.createDataFrame([(1,), (9,)], "node bigint")
    assert labels(C.connected_components(frame(spark, [(1, 2)]), vertices=nodes)) == {1: 1, 2: 1, 9: 9}
    empty = C.connected_components(frame(spark, []))
    assert empty.converged and labels(empty) == {}


def test_many_graphs_in_one_pass(spark):
    rows = [("x", 1, 2), ("x", 2, 3), ("y", 2, 5), ("y", 7, 8)]
    edges = spark.createDataFrame(rows, "graph string, src bigint, dst bigint")
    for algorithm in ("star", "minlabel", "selfmsg", "rewrite"):
        found = C.connected_components(edges, algorithm, by=["graph"]).labels.collect()
        assert {(r["graph"], r["node"]): r["component"] for r in found} == {
            ("x", 1): 1, ("x", 2): 1, ("x", 3): 1, ("y", 2): 2, ("y", 5): 2, ("y", 7): 7, ("y", 8): 7,
        }
    summary = {r["graph"]: r for r in C.summary(edges, by=["graph"]).collect()}
    assert summary["y"]["n_components"] == 2 and summary["y"]["converged"]


def test_batch_isolates_failures(spark, tmp_path):
    from edgewise.sources import edge_files

    def missing():
        return edge_files.read_csv(spark, str(tmp_path / "absent.csv"))

    rows = C.batch({"bad": missing, "good": lambda: frame(spark, [(1, 2), (3, 4)])}).collect()
    bad, good = rows
    assert bad["error"] and bad["n_nodes"] is None
    assert good["error"] is None and good["n_components"] == 2 and good["n_edges"] == 2


def test_label_changes_and_sizes(spark):
    old = spark.createDataFrame([(1, 1), (2, 2)], "node bigint, component bigint")
    new = spark.createDataFrame([(1, 1), (2, 1)], "node bigint, component bigint")
    assert C.label_changes(old, new).first()["n_changed"] == 1
    assert C.component_sizes(new).collect() == [(1, 2)]
    assert C.component_count(new).first()["n_components"] == 1


def test_stats(spark):
    row = E.stats(frame(spark, [(1, 2), (2, 1), (3, 3), (None, 1)])).first()
    assert (row["n_nodes"], row["n_rows"], row["n_edges"], row["n_distinct_edges"]) == (3, 4, 3, 2)


def test_named_components_drop_rows_outside(spark):
    # fixed input: the sample follower graph
    follows = [(2, 1), (4, 1), (1, 2), (6, 3), (7, 3), (7, 6), (6, 7), (3, 7)]
    users = spark.createDataFrame([(1, "u1"), (6, "u6"), (8, "u8")], "node bigint, name string")
    found = C.named(C.connected_components(frame(spark, follows)).labels, users)
    assert {r["name"]: r["component"] for r in found.collect()} == {"u1": 1, "u6": 3}


def test_state_survives_in_shared_folder(spark):
    from edgewise.plans.scratch import Scratch

    scratch = Scratch(spark, "t")
    table = scratch.write(spark.range(10))
    assert table.df.count() == 10
    table.drop()
    with pytest.raises(Exception):
        table.df.count()


def test_property_graph(spark):
    from pyspark.sql import functions as F

    vertices = spark.createDataFrame([(1, 40), (2, 20), (3, 30)], "id bigint, age int")
    graph = PropertyGraph(vertices, frame(spark, [(1, 2), (3, 2), (2, 1)]))
    older = graph.aggregate_messages(
        F.col("source.age") > F.col("target.age"),
        {"one": F.lit(1), "age": F.col("source.age")},
        [F.sum("one").alias("n"), F.avg("age").alias("mean")],
    )
    assert older.collect() == [(2, 2, 35.0)]
    assert graph.subgraph(F.col("age") > 25).edges.collect() == []
    names = spark.createDataFrame([(1, "a")], "id bigint, name string")
    joined = graph.join_vertices(names, {"name": ""}).vertices
    assert {r["id"]: r["name"] for r in joined.collect()} == {1: "a", 2: "", 3: ""}
    for strategy in ("1d", "2d", "random", "canonical"):
        assert graph.partition_by(strategy, 4).edges.count() == 3
    assert labels(graph.connected_components()) == {1: 1, 2: 1, 3: 1}
