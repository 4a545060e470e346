"""Connected components of undirected edge lists.

Every algorithm maps each node to the smallest node of its component once it
has converged; they differ in the rounds and the data moved per round.

=============  ==========================================  ====================
name           state                                       rounds
=============  ==========================================  ====================
star           edges, rewritten to stars                   about log(nodes)
rewrite        (node, label) pairs, rewritten              about log(nodes)
hooking        (node, label) pairs over the given edges    longest shortest path
minlabel       one label per node over the given edges     longest shortest path
selfmsg        as minlabel, a node also messages itself    longest shortest path
=============  ==========================================  ====================
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators import edges as E
from edgewise.plans.fixpoint import LoopResult, iterate
from edgewise.plans.grid import GridRows
from edgewise.plans.scratch import Scratch, Table
from edgewise.plans.skew import MIN_HOT_ROWS, KeyedRows, distinct_with_low

#: Edges from which on `star` first makes stars of the edges of each chunk.
MIN_CHUNKED = 1_000_000
#: Edges of a chunk.
CHUNK_ROWS = 1 << 20


@dataclass
class ComponentsResult:
    """`labels` has one row `(node, component)` per node."""

    labels: DataFrame
    iterations: int
    converged: bool
    changes: list[int]
    scratch: Scratch

    def release(self) -> None:
        """Delete the files behind `labels`."""
        self.scratch.drop_all()


def connected_components(
    edges: DataFrame,
    algorithm: str = "star",
    max_iters: int | None = None,
    vertices: DataFrame | None = None,
    by: Sequence[str] = (),
    layout: str = "1d",
) -> ComponentsResult:
    """Components of `edges(src, dst)`, per graph if `by` names key columns.

    `layout="2d"` lets `minlabel` send its labels over edges in a grid of cells.

    Ends that are null are dropped. `vertices(node)` adds nodes without edges.
    Runs until nothing changes. With `max_iters` it stops after so many rounds; a
    result that is not final then is flagged `converged=False` and still holds one
    row per node.
    """
    scratch = Scratch(edges.sparkSession, "components")
    by = list(by)
    # the rewriting algorithms remove duplicates in the sort of every round
    prepare = E.oriented if algorithm in ("star", "rewrite") else E.canonical
    simple = scratch.write(prepare(edges, by))
    run = {
        "star": _star,
        "rewrite": _rewrite,
        "hooking": _hooking,
        "minlabel": _minlabel,
        "selfmsg": _selfmsg,
    }[algorithm]
    if layout == "2d":
        if algorithm != "minlabel":
            raise ValueError(f"{algorithm} has no grid layout")
        loop = _minlabel(scratch, simple, by, max_iters, grid=True)
    else:
        loop = run(scratch, simple, by, max_iters)
    # no algorithm loses a node with an edge to another one, so the node list comes
    # from the small final state and not from a second pass over all edges
    own = loop.state.selectExpr(*by, "component as node").unionByName(
        simple.df.where("src = dst").selectExpr(*by, "src as node")
    )
    if vertices is not None:
        own = own.unionByName(vertices.select(*by, "node").na.drop())
    labels = scratch.write(
        loop.state.select(*by, "node", "component")
        .unionByName(own.selectExpr(*by, "node", "node as component"))
        .groupBy(*by, "node")
        .agg(F.min("component").alias("component"))
    )
    simple.drop()
    return ComponentsResult(labels.df, loop.iterations, loop.converged, loop.changes, scratch)


def _count(table: Table) -> int:
    return table.df.count()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The batches put together to tables of `size` rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _chunk_star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that is not the smallest of its component, and that smallest one."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(x):
        # the larger root goes below the smallest root it meets, then each node points at its root
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, above := label[label]):
            label = above
        x, y = label[x], label[y]
        apart = x != y
        x, y = x[apart], y[apart]
    below = np.flatnonzero(label != np.arange(len(names)))
    return names[below], names[label[below]]


def _chunk_stars(edges: DataFrame) -> DataFrame:
    """`(hi, lo)`: stars that connect the same nodes as `edges(hi, lo)`, made of each chunk of a task.

    Nothing is shuffled. A chunk gives an edge less than it has nodes for each of its components,
    so never more than it has.
    """
    size = CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            hi, lo = _chunk_star(chunk["hi"].to_numpy(), chunk["lo"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    return edges.select("hi", "lo").mapInArrow(run, "hi bigint, lo bigint")


def _star(scratch: Scratch, simple: Table, by: list[str], max_iters: int | None) -> LoopResult:
    """Alternating large-star and small-star steps; one round is one of each.

    State: edges `(hi, lo)` with hi > lo. Large star links every larger
    neighbour of a node to the smallest node around it, small star does so for
    the smaller neighbours. When neither moves an edge, all edges point at the
    smallest node of their component. Many edges of one graph with whole numbers as nodes
    are first made stars chunk by chunk, so that the sorts of the first rounds get fewer.
    """
    start = simple.view(simple.df.where("src <> dst").selectExpr(*by, "dst as hi", "src as lo"))
    n = _count(simple)
    if n > MIN_CHUNKED and not by and {kind for _, kind in start.df.dtypes} == {"bigint"}:
        start = scratch.write(_chunk_stars(start.df))
        n = _count(start)
    halfway: list[Table] = []

    def step(state: DataFrame, n: int) -> DataFrame:
        both = E.symmetric(state.selectExpr(*by, "hi as src", "lo as dst"), by)
        large = (
            distinct_with_low(both, [*by, "src"], "dst", 2 * n)
            .where("dst > src")
            .selectExpr(
                *by, "dst as hi", "least(src, low) as lo", "int(low < src) as changed"
            )
        )
        if n > MIN_HOT_ROWS:
            # the hot-key pass below would otherwise run the large star again
            while halfway:
                halfway.pop().drop()
            halfway.append(scratch.write(large))
            large = halfway[-1].df
        small = distinct_with_low(large, [*by, "hi"], "lo", n, extra="changed")
        return small.selectExpr(
            *by,
            "if(lo <> low, lo, hi) as hi",
            "low as lo",
            "greatest(changed, int(lo <> low)) as changed",
        )

    loop = iterate(scratch, start, step, max_iters, n=n)
    while halfway:
        halfway.pop().drop()
    loop.state = loop.state.select(*by, F.col("hi").alias("node"), F.col("lo").alias("component"))
    return loop


def _rewrite(scratch: Scratch, simple: Table, by: list[str], max_iters: int | None) -> LoopResult:
    """Published pair rewriting: each round groups the pairs in both directions.

    Per key, `m` is the smallest value; a key above `m` emits `(key, m)` and
    `(v, m)` for its other values. The given edges are forgotten.
    """
    start = simple.view(
        simple.df.where("src <> dst").selectExpr(*by, "dst as node", "src as component")
    )

    def step(state: DataFrame, n: int) -> DataFrame:
        pairs = E.symmetric(state.selectExpr(*by, "node as src", "component as dst"), by)
        return (
            distinct_with_low(pairs, [*by, "src"], "dst", 2 * n)
            .where("low < src")
            .selectExpr(
                *by,
                "if(dst <> low, dst, src) as node",
                "low as component",
                "int(dst <> low) as changed",
            )
        )

    return iterate(scratch, start, step, max_iters, n=_count(simple))


def _labels(scratch: Scratch, simple: Table, by: list[str]) -> Table:
    return scratch.write(
        E.vertices(simple.df, by).select(
            *by,
            "node",
            F.col("node").alias("component"),
            F.lit(True).alias("changed"),
        )
    )


def _neighbours(simple: Table, by: list[str], total: int) -> KeyedRows:
    flat = E.symmetric(simple.df.where("src <> dst"), by)
    return KeyedRows(
        flat.select(*by, F.col("src").alias("node"), F.col("dst").alias("to")),
        [*by, "node"],
        total=total,
    )


def _hooking(scratch: Scratch, simple: Table, by: list[str], max_iters: int | None) -> LoopResult:
    """Label hooking: the reducer of pair rewriting over the given edges.

    A label that is itself a node is re-pointed too, which is why the state may
    hold several rows per node until it has converged.
    """
    edges = _neighbours(simple, by, 2 * _count(simple))
    start = _labels(scratch, simple, by)

    held: list[Table] = []

    def step(state: DataFrame, n: int) -> DataFrame:
        pairs = state.select(*by, "node", "component").distinct()
        sent = edges.join_many(pairs).select(*by, F.col("to").alias("node"), "component")
        # equal values of a key are counted before they are shuffled
        values = scratch.write(
            sent.unionByName(pairs)
            .groupBy(*by, "node", "component")
            .agg(F.count(F.lit(1)).alias("times"))
        )
        while held:
            held.pop().drop()
        held.append(values)
        low = distinct_with_low(
            values.df, [*by, "node"], "component", _count(values), extra="times"
        )
        return low.where("low < node or component = low").selectExpr(
            *by,
            "if(component <> low, component, node) as node",
            "least(low, node) as component",
            "if(component <> low, times, 0) as changed",
        )

    try:
        return iterate(scratch, start, step, max_iters)
    finally:
        edges.release()
        while held:
            held.pop().drop()


def _minlabel(
    scratch: Scratch, simple: Table, by: list[str], max_iters: int | None, grid: bool = False
) -> LoopResult:
    """Smallest label of the neighbours, then the smaller of that and the own one."""
    if grid:
        edges = GridRows(E.symmetric(simple.df.where("src <> dst"), by).selectExpr(*by, "src as node", "dst as to"), [*by, "node"])
    else:
        edges = _neighbours(simple, by, 2 * _count(simple))
    start = _labels(scratch, simple, by)

    def step(state: DataFrame, n: int) -> DataFrame:
        # a neighbour whose label did not move has nothing new to say
        moved = state.where("changed").select(*by, "node", "component")
        if grid:
            around = edges.send(moved, "component", F.min, "offer")
        else:
            around = edges.join(moved).groupBy(*by, F.col("to").alias("node")).agg(F.min("component").alias("offer"))
        return (
            state.select(*by, "node", "component")
            .join(around, [*by, "node"], "left")
            .selectExpr(
                *by,
                "node",
                "least(component, offer) as component",
                "coalesce(offer < component, false) as changed",
            )
        )

    try:
        return iterate(scratch, start, step, max_iters)
    finally:
        edges.release()


def _selfmsg(scratch: Scratch, simple: Table, by: list[str], max_iters: int | None) -> LoopResult:
    """Labels are sent to the neighbours and to the node itself; the minimum stays.

    The message to itself carries the old label, so the new label and the change
    flag come out of one aggregation and no second join is needed.
    """
    edges = _neighbours(simple, by, 2 * _count(simple))
    start = _labels(scratch, simple, by)

    def step(state: DataFrame, n: int) -> DataFrame:
        own = state.selectExpr(*by, "node", "component", "component as old")
        moved = state.where("changed").select(*by, "node", "component")
        sent = edges.join(moved).selectExpr(
            *by, "to as node", "component", "nullif(component, component) as old"
        )
        return (
            own.unionByName(sent)
            .groupBy(*by, "node")
            .agg(F.min("component").alias("component"), F.min("old").alias("old"))
            .selectExpr(*by, "node", "component", "component < old as changed")
        )

    try:
        return iterate(scratch, start, step, max_iters)
    finally:
        edges.release()


def label_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row with the number of nodes whose component differs."""
    pair = old.select("node", F.col("component").alias("was")).join(new, "node")
    return pair.agg(
        F.coalesce(F.sum((F.col("was") != F.col("component")).cast("bigint")), F.lit(0)).alias(
            "n_changed"
        )
    )


def component_count(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of components; a component is counted at its own label node."""
    return (
        labels.where("node = component")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_components"))
    )


def component_sizes(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labels.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n_nodes"))


def listing(labels: DataFrame) -> DataFrame:
    """Labels in node order (a range-partitioned sort)."""
    return labels.orderBy("node")


def named(labels: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes of `attributes(node, ...)` with their component; others drop out."""
    return attributes.join(labels, "node")


def summary(edges: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Per graph: nodes, valid edges, components, rounds and convergence of the run."""
    result = connected_components(edges, by=by, **options)
    counts = E.stats(edges, by).select(*by, "n_nodes", "n_edges")
    found = component_count(result.labels, by)
    keys = list(by)
    if not keys:
        # one-row aggregates on both sides
        keys = ["_one"]
        counts, found = (d.withColumn("_one", F.lit(1)) for d in (counts, found))
    # a graph with a null key or without a valid edge has no components, but a row
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_components")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return counts.join(found, same, "left").select(
        *by,
        "n_nodes",
        "n_edges",
        F.coalesce("n_components", F.lit(0)).cast("bigint").alias("n_components"),
        F.lit(result.iterations).alias("iterations"),
        F.lit(result.converged).alias("converged"),
    )


def batch(loaders: dict[str, Callable[[], DataFrame]], **options) -> DataFrame:
    """One summary row per named graph; a graph that fails gives a row with its error.

    Graphs of one table are better done in one pass with `by`.
    """
    rows = []
    for name, load in loaders.items():
        started = time.perf_counter()
        try:
            row = summary(load(), **options).first().asDict()
            error = None
        except Exception as caught:  # any failure of one graph must not stop the others
            row, error = {}, f"{type(caught).__name__}: {str(caught).splitlines()[0]}"
        rows.append(
            (
                name,
                *(row.get(c) for c in ("n_nodes", "n_edges", "n_components", "iterations")),
                row.get("converged"),
                round(time.perf_counter() - started, 3),
                error,
            )
        )
    return SparkSession.active().createDataFrame(
        rows,
        "graph string, n_nodes bigint, n_edges bigint, n_components bigint, iterations int,"
        " converged boolean, seconds double, error string",
    )
