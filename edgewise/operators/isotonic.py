"""Isotonic regression of any number of points, without one place that sees all of them.

Points are summed per distinct x and sorted into chunks of bounded size. A task pools adjacent
violators inside a chunk, which leaves blocks of rising means. Then pairs of
neighbouring chunks are pooled together, as long as any chunk's last block is not below the
next one's first. Pooling gives the same blocks in any order, so the result is that of
one pass over everything. Chunks that have shrunk are joined to their neighbours first,
so a long fall is pooled as a tree: half as many chunks a round.

What the driver sees is the number of blocks of a chunk and the means at its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

#: Blocks of a chunk at most.
CHUNK = 100_000
BLOCK = "chunk int, low double, high double, total double, weight double"


def pool(total: np.ndarray, weight: np.ndarray, rising: bool = True) -> np.ndarray:
    """Where the pooled blocks of rows in order begin; equal means are pooled too."""
    starts, sums, weights = [], [], []
    sign = 1.0 if rising else -1.0
    for i, (s, w) in enumerate(zip((sign * total).tolist(), weight.tolist(), strict=True)):
        start = i
        while starts and sums[-1] * w >= s * weights[-1]:
            start = starts.pop()
            s, w = s + sums.pop(), w + weights.pop()
        starts.append(start)
        sums.append(s)
        weights.append(w)
    return np.array(starts, np.int64)


def _pooled(pdf: pd.DataFrame, rising: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("low", kind="stable")
    starts = pool(pdf["total"].to_numpy(), pdf["weight"].to_numpy(), rising)
    ends = np.append(starts[1:], len(pdf)) - 1
    return pd.DataFrame(
        {
            "low": pdf["low"].to_numpy()[starts],
            "high": pdf["high"].to_numpy()[ends],
            "total": np.add.reduceat(pdf["total"].to_numpy(), starts),
            "weight": np.add.reduceat(pdf["weight"].to_numpy(), starts),
        }
    )


class Chunks:
    """Blocks on scratch storage, a chunk at most `size` of them, in the order of x."""

    def __init__(self, points: DataFrame, rising: bool, size: int, scratch: Scratch):
        self.rising, self.size, self.scratch = rising, size, scratch
        self.rounds = 0
        summed = points.groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
        plain = scratch.write(summed.select(F.col("x").alias("low"), F.col("x").alias("high"), "total", "weight")).df
        parts = max(1, -(-2 * plain.count() // size))
        # ranges are cut from a sample of x: about half of a chunk each
        ranged = plain.repartitionByRange(parts, "low").withColumn("chunk", F.spark_partition_id())
        self.table = scratch.write(ranged.select("chunk", "low", "high", "total", "weight"))
        self._pool(self.table.df)

    def _pool(self, numbered: DataFrame) -> None:
        """Pool the rows of each chunk number; where more blocks are left than a chunk may have, two chunks."""
        rising, size = self.rising, self.size

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            out = _pooled(pdf, rising)
            half = len(out) // 2 if len(out) > size else len(out)
            return out.assign(chunk=2 * key[0] + (np.arange(len(out)) >= half))[["chunk", "low", "high", "total", "weight"]]

        new = self.scratch.write(numbered.groupBy("chunk").applyInPandas(run, BLOCK))
        self.table.drop()
        self.table = new

    def ends(self) -> list:
        """Chunks in order: number, blocks, means of the first and last block."""
        mean = F.col("total") / F.col("weight")
        found = self.table.df.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        return sorted(found.collect())

    def settle(self) -> DataFrame:
        """Pool neighbours until the blocks of all chunks rise."""
        while True:
            ends = self.ends()
            sign = 1 if self.rising else -1
            wrong = [sign * a["last"] >= sign * b["first"] for a, b in zip(ends, ends[1:], strict=False)]
            if not any(wrong):
                return self.table.df
            # from the left: a chunk takes its neighbour if the two violate, and more while all fit into one
            groups, held, pair = [], 0, False
            for i, row in enumerate(ends):
                if i and (held + row["n"] <= self.size or (wrong[i - 1] and not pair)):
                    pair = pair or held + row["n"] > self.size
                    held += row["n"]
                else:
                    number, held, pair = i, row["n"], False
                groups.append((row["chunk"], number))
            named = self.table.df.sparkSession.createDataFrame(groups, "chunk int, _group int")
            self._pool(self.table.df.join(F.broadcast(named), "chunk").withColumn("chunk", F.col("_group")).drop("_group"))
            self.rounds += 1


def isotonic(points: DataFrame, rising: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Blocks `(low, high, value, weight)` of the best monotone fit to `points(x, y, w)`.

    Least weighted squares; rows with a null or a weight that is not above 0 are left out, equal x are
    one point. `value` holds from `low` to `high`. An empty table gives no block.
    """
    known = points.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w")]).na.drop().where("w > 0")
    chunks = Chunks(known, rising, chunk, Scratch(points.sparkSession, "isotonic"))
    return chunks.settle().select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def fitted(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """`(x, fitted)` for each distinct x of `points`: the value of the block that begins last at or before x.

    x and blocks are sorted into ranges together; a range that begins inside a block takes
    its value from the range before.
    """
    scratch = Scratch(points.sparkSession, "fitted")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = points.select(F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("value")).na.drop(subset=["x"]).distinct()
    both = both.unionByName(blocks.select(F.col("low").alias("x"), "value"))
    ranged = scratch.write(both.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id())).df
    last, carried = None, []
    for r in sorted(ranged.groupBy("part").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("x"))).alias("last")).collect()):
        carried.append((r["part"], last))
        last = last if r["last"] is None else r["last"]
    before = points.sparkSession.createDataFrame(carried, "part int, carried double")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # at equal x the beginning of the block comes first
        pdf = pdf.sort_values(["x", "value"], na_position="last", kind="stable")
        value = pdf["value"].ffill().fillna(pdf["carried"])
        return pd.DataFrame({"x": pdf["x"], "fitted": value})[pdf["value"].isna().to_numpy()]

    return ranged.join(F.broadcast(before), "part").groupBy("part").applyInPandas(fill, "x double, fitted double")
