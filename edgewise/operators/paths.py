"""Reachability and shortest paths over directed edge tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from edgewise.operators import edges as E
from edgewise.plans.fixpoint import LoopResult
from edgewise.plans.scratch import Scratch, Table
from edgewise.plans.skew import KeyedRows


def shortest_paths(
    edges: DataFrame,
    sources: DataFrame,
    vertices: DataFrame | None = None,
    max_iters: int | None = None,
) -> LoopResult:
    """Least total weight from `sources(node)` to every node, infinity if none.

    `edges(src, dst, weight)` is directed. Only nodes whose distance fell in the
    last round relax their out-edges. Parallel edges are reduced to the lightest.

    The distances lie partitioned by node in a cache. A round moves offers only, compares them
    where the distances are and writes those that fell; when the written rows outgrow
    the nodes they are merged into new distances.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    light = scratch.write(
        edges.na.drop().groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    )
    routes = KeyedRows(
        light.df.selectExpr("src as node", "dst as to", "weight"), ["node"], light.df.count()
    )
    nodes = E.vertices(light.df)
    if vertices is not None:
        nodes = nodes.unionByName(vertices.select("node")).distinct()
    is_source = sources.select("node").distinct().withColumn("near", F.lit(0.0))
    first = nodes.join(is_source, "node", "left").selectExpr("node", "coalesce(near, double('inf')) as distance")
    held = _Laid(scratch.write(first).df, ["node"])
    n = held.size
    # sources that are no node are not told
    fell, changes, done = [scratch.write(held.df.where("distance = 0"))], [], False
    written = 0
    while not done and (max_iters is None or len(changes) < max_iters):
        front = fell[-1].df
        offers = routes.join(front).selectExpr("to as node", "distance + weight as offer").groupBy("node").agg(F.min("offer").alias("offer"))
        # what fell since the distances were laid out; later is lower
        since = fell[1:] if held.rounds else fell
        for part in since:
            offers = offers.join(part.df.withColumnRenamed("distance", "_d"), "node", "left").where("_d is null or offer < _d").drop("_d")
        told = Observation()
        better = held.df.join(offers, "node").where("offer < distance").selectExpr("node", "offer as distance")
        fell.append(scratch.write(better.observe(told, F.count(F.lit(1)).alias("n"))))
        changes.append(told.get["n"])
        written += changes[-1]
        done = changes[-1] == 0
        if written > n or len(fell) > MAX_PARTS:
            held = held.replace(scratch, _merged(held.df, fell))
            fell, written = [fell[-1]], 0
    state = scratch.write(_merged(held.df, fell)).df
    held.release()
    routes.release()
    light.drop()
    return LoopResult(state, len(changes), done, changes)


#: Small tables that a round looks at before they are merged.
MAX_PARTS = 8


class _Laid:
    """Rows cached where the hash of their key sends them."""

    def __init__(self, rows: DataFrame, key: list[str], rounds: int = 0):
        self.key, self.rounds = key, rounds
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.df = rows.repartition(parts, *key).persist(StorageLevel.MEMORY_AND_DISK)
        self.size = self.df.count()  # the planner knows the layout of a cache that is there

    def replace(self, scratch: Scratch, rows: DataFrame) -> "_Laid":
        new = _Laid(scratch.write(rows).df, self.key, self.rounds + 1)
        self.release()
        return new

    def release(self) -> None:
        self.df.unpersist()


def _merged(distances: DataFrame, fell: list[Table]) -> DataFrame:
    """The least distance of each node."""
    rows = distances
    for part in fell:
        rows = rows.unionByName(part.df)
    return rows.groupBy("node").agg(F.min("distance").alias("distance"))


def transitive_closure(edges: DataFrame, max_iters: int | None = None) -> LoopResult:
    """All `(src, dst)` with a directed path of one edge or more.

    Semi-naive: a round extends only the pairs found in the round before. The pairs of
    each round lie in a cache of their own, partitioned by pair, so a round shuffles its new
    pairs only and removes the known ones where those are. The rows are written too; a lost
    cache is read again.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    base = scratch.write(E.clean(edges).distinct())
    routes = KeyedRows(base.df.selectExpr("src as mid", "dst as far"), ["mid"], base.df.count())
    found, laid, changes, done = [base], [_Laid(base.df, ["src", "dst"])], [], False
    while not done and (max_iters is None or len(changes) < max_iters):
        longer = routes.join_many(found[-1].df.selectExpr("src", "dst as mid")).selectExpr("src", "far as dst").distinct()
        for part in laid:
            longer = longer.join(part.df, ["src", "dst"], "left_anti")
        told = Observation()
        found.append(scratch.write(longer.observe(told, F.count(F.lit(1)).alias("n"))))
        changes.append(told.get["n"])
        done = changes[-1] == 0
        if not done:
            laid.append(_Laid(found[-1].df, ["src", "dst"]))
        if len(laid) > MAX_PARTS:
            known = _Laid(_union([f.df for f in found]), ["src", "dst"])
            for part in laid:
                part.release()
            laid = [known]
    routes.release()
    for part in laid:
        part.release()
    return LoopResult(_union([f.df for f in found]), len(changes), done, changes)


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows
