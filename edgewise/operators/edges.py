"""Edge tables: canonical form, both directions, vertices, statistics.

An edge table has the columns `src` and `dst` (bigint by default, any orderable
type works) and, for several graphs in one table, the key columns named in `by`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop edges with a missing end."""
    return edges.select(*by, "src", "dst").na.drop(subset=["src", "dst"])


def oriented(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges with the smaller end first; duplicates stay, nothing is shuffled."""
    return clean(edges, by).select(
        *by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    )


def canonical(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undirected edges once each, the smaller end first; self loops stay."""
    return oriented(edges, by).distinct()


def symmetric(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both directions of every row, duplicates kept."""
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(*by, F.inline(F.array(there, back)))


def vertices(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct end points as `node`."""
    ends = F.explode(F.array("src", "dst")).alias("node")
    return clean(edges, by).select(*by, ends).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Sorted neighbour list per vertex.

    The list is the product asked for, so one row is as long as its vertex has
    distinct neighbours; the loops in this package use flat edges instead.
    """
    return (
        symmetric(oriented(edges))
        .groupBy(F.col("src").alias("node"))
        .agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours per vertex, self loops not counted."""
    return simple_degrees(canonical(edges).where("src <> dst"))


def simple_degrees(simple: DataFrame) -> DataFrame:
    """Degrees of edges that are distinct and without self loops already."""
    ends = F.explode(F.array("src", "dst")).alias("node")
    return simple.select(ends).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_histogram(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """How many vertices have each degree; vertices without an edge count as 0."""
    nodes = vertices(edges) if nodes is None else nodes.select("node").distinct()
    return (
        nodes.join(degrees(edges), "node", "left")
        .select(F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
        .groupBy("degree")
        .agg(F.count(F.lit(1)).alias("n_nodes"))
    )


def stats(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Raw, valid and distinct edge counts and the node count, one row per graph."""
    both = F.col("src").isNotNull() & F.col("dst").isNotNull()
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    # one partial row per distinct pair first, so hub vertices shrink before the shuffle
    grouped = edges.groupBy(*by, F.when(both, pair).alias("pair")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    counts = grouped.groupBy(*by).agg(
        F.sum("rows").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("pair").isNotNull(), F.col("rows"))), F.lit(0)).alias(
            "n_edges"
        ),
        F.count("pair").alias("n_distinct_edges"),
    )
    nodes = vertices(edges, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_nodes"))
    if by:
        joined = counts.join(nodes, list(by), "left")
    else:
        # both sides are one-row aggregates
        joined = counts.withColumn("_one", F.lit(1)).join(
            nodes.withColumn("_one", F.lit(1)), "_one"
        )
    return joined.select(
        *by,
        F.coalesce("n_nodes", F.lit(0)).cast("bigint").alias("n_nodes"),
        "n_rows",
        "n_edges",
        "n_distinct_edges",
    )
