"""Edges laid out in a square grid of cells, for loops that send state along them.

An edge lies in the cell of the hashes of both its ends. So the edges out of a node lie in one
row of the grid and those into a node in one column: of p cells, sqrt(p) at most. A routing
table, made once, tells in which cells a node has edges. A round sends a node's state to those
cells only, adds up what each cell has for a target there, and sends one row per cell and
target on. In a layout by source each target gets up to p partial rows; here sqrt(p), which
outweighs the copies of the state where nodes have many edges. A node with a very large share
of the edges has them in sqrt(p) cells instead of one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def own_tasks(spark: SparkSession, cells: int) -> list[int]:
    """As many numbers, of which each is hashed to a task of its own.

    The numbers 0, 1, ... would be hashed to two thirds of the tasks, several of them to one.
    """
    # of `n` times as many numbers, a task gets none with a probability of exp(-n)
    found: dict[int, int] = {}
    last = 0
    while len(found) < cells:
        number = F.col("id").cast("int")
        tried = spark.range(last, last + 32 * cells, 1, 1).select(F.pmod(F.hash(number), F.lit(cells)).alias("task"), number.alias("number"))
        for row in tried.groupBy("task").agg(F.min("number").alias("number")).collect():
            found.setdefault(row["task"], row["number"])
        last += 32 * cells
    return [found[task] for task in range(cells)]


class GridRows:
    """`rows(node, to)` in a grid of cells; `send` is what a round does with them."""

    #: Joins and aggregates on (cell, ...) find the rows of a cell where they are.
    SETTING = "spark.sql.requireAllClusterKeysForCoPartition"

    def __init__(self, rows: DataFrame, key: Sequence[str], parts: int | None = None):
        spark = rows.sparkSession
        self.key = list(key)
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        side = max(1, math.isqrt(parts))
        self.cells = side * side
        self.by = [k for k in self.key if k != "node"]
        cell = F.pmod(F.xxhash64(*self.key), F.lit(side)) * side + F.pmod(F.xxhash64(*self.by, "to", F.lit(1)), F.lit(side))
        # of the number of a cell only its hash counts, which decides on the task
        numbers = F.array(*[F.lit(n) for n in own_tasks(spark, self.cells)])
        placed = rows.withColumn("cell", F.get(numbers, cell.cast("int")))
        self.edges = placed.repartition(self.cells, "cell").sortWithinPartitions("cell", *self.key).persist(StorageLevel.MEMORY_AND_DISK)
        self.spark, self.before = spark, spark.conf.get(self.SETTING)
        spark.conf.set(self.SETTING, "false")
        # a cached table tells the planner how it is laid out once it is there
        self.edges.count()
        self.routes = self.edges.select("cell", *self.key).distinct().repartition(self.cells, *self.key).persist(StorageLevel.MEMORY_AND_DISK)
        self.routes.count()

    def routed(self, state: DataFrame) -> DataFrame:
        """`state`, one row per node, in every cell where the node has an edge."""
        # the state goes to the routes, the routes stay where they are
        return self.routes.join(state.repartition(self.cells, *self.key), self.key).repartition(self.cells, "cell")

    def partial(self, state: DataFrame, aggregate: Column, name: str) -> DataFrame:
        """One row per cell and target."""
        met = self.edges.join(self.routed(state), ["cell", *self.key])
        return met.groupBy("cell", *self.by, F.col("to")).agg(aggregate.alias(name))

    def send(self, state: DataFrame, each: str, how, name: str) -> DataFrame:
        """`(node, <name>)`: `how` (F.sum or F.min) of `each` over the edges into a node."""
        parts = self.partial(state, how(each), "_part")
        return parts.groupBy(*self.by, F.col("to").alias("node")).agg(how("_part").alias(name))

    def release(self) -> None:
        self.edges.unpersist()
        self.routes.unpersist()
        self.spark.conf.set(self.SETTING, self.before)
