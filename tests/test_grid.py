"""Loops over edges in a grid of cells: the same rows, less sent on a graph of hubs."""

import random

import pytest
from pyspark.sql import functions as F

from edgewise.operators.components import connected_components
from edgewise.operators.rank import pagerank
from edgewise.plans.grid import GridRows


def exchanges(df):
    """Shuffles of a plan; those behind cached tables are not its children."""

    def walk(node):
        if node.nodeName() == "Exchange":
            yield node.outputPartitioning().toString()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return [x.partition("#")[0] for x in walk(df._jdf.queryExecution().executedPlan().initialPlan())]


def hubs(spark):
    """Each of 300 nodes points at 60 of 80 hubs."""
    rng = random.Random(8)
    pairs = [(1000 + i, h) for i in range(300) for h in rng.sample(range(80), 60)]
    return spark.createDataFrame(pairs, "src long, dst long")


def test_ranks_do_not_depend_on_the_layout(spark):
    edges = hubs(spark).unionByName(spark.createDataFrame([(1, 2), (2, 1000), (None, 4), (5, 5)], "src long, dst long"))
    for options in ({"rounds": 4}, {"rounds": 4, "keep_all": False}, {"rounds": None, "tol": 1e-3}):
        flat, grid = (sorted((r["node"], round(r["rank"], 9)) for r in pagerank(edges, layout=x, **options).state.collect()) for x in ("1d", "2d"))
        assert flat == grid and len(flat) > 50
    with pytest.raises(ValueError):
        pagerank(edges, layout="3d")


def test_components_do_not_depend_on_the_layout(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 7, 8), ("h", 3, 7), ("h", 9, 9)], "graph string, src long, dst long")
    flat, grid = (sorted(map(tuple, connected_components(edges, "minlabel", by=["graph"], layout=x).labels.collect())) for x in ("1d", "2d"))
    assert flat == grid
    with pytest.raises(ValueError):
        connected_components(edges, "star", by=["graph"], layout="2d")


def test_less_is_sent_on_a_graph_of_hubs(spark):
    parts = 64
    rows = hubs(spark).selectExpr("src as node", "dst as to")
    state = rows.select("node").distinct().withColumn("share", F.lit(1.0))
    grid = GridRows(rows, ["node"], parts)
    try:
        copies, sums = grid.routed(state).count(), grid.partial(state, F.sum("share"), "s").count()
        # the state, its copies and the sums are shuffled, the edges and routes are not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        fresh = spark.createDataFrame(state.collect(), state.schema)
        assert sorted(exchanges(grid.send(fresh, "share", F.sum, "gain"))) == [f"hashpartitioning({x}" for x in ("cell", "node", "to")]
    finally:
        grid.release()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_source = rows.repartition(parts, "node").groupBy(F.spark_partition_id(), "to").count().count()
    # the form by source sends the state once and up to a row per partition and target
    assert state.count() + copies + sums < state.count() + by_source
    assert spark.conf.get(GridRows.SETTING) == "true"


def test_each_cell_has_a_task_of_its_own(spark):
    grid = GridRows(hubs(spark).selectExpr("src as node", "dst as to"), ["node"], 16)
    try:
        placed = grid.edges.select("cell", F.spark_partition_id().alias("task")).distinct()
        assert grid.cells == placed.count() == placed.select("task").distinct().count() == 16
    finally:
        grid.release()
