"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows per group of the two-level running sum.
PREFIX_GROUP = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over many tasks.

    Functions travel to the workers by value, so their own globals are new in
    every task; a registered module is not.
    """
    held = sys.modules.setdefault("_edgewise_worker", types.ModuleType("_edgewise_worker"))
    return held.__dict__.setdefault(name, {})


def text_parts(docs: DataFrame, column: str = "text", megabytes: int = 32) -> int:
    """Partitions of about `megabytes` of text each, from the bytes of all rows."""
    total = docs.agg(F.sum(F.octet_length(F.col(column)).cast("long") + 64)).first()[0] or 0
    return max(1, -(-total // (megabytes << 20)))


def running_total(parts: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """`parts(order, value)` with the sum of `value` over all rows of lower `order`.

    `order` is a dense, unique, non-negative number. Two levels: sums within
    groups of PREFIX_GROUP rows, and one row per group above them, so the step
    that runs in one task has 1/4096 of the rows.
    """
    group = F.floor(F.col(order) / PREFIX_GROUP)
    inner = Window.partitionBy("_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    grouped = parts.select(order, value, group.alias("_group"))
    above = grouped.groupBy("_group").agg(F.sum(value).alias("_sum"))
    above = above.select("_group", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_above"))
    return (
        grouped.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .join(above, "_group")
        .select(order, (F.col("_above") + F.col("_within")).alias(out))
    )


def spans(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items with at most `limit` units each (or one item); `ends` counts units from 0."""
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs `values[start:start + size]` one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Known:
    """Ids of strings that a worker has met, as columns: about 25 bytes a string.

    When the columns outgrow `limit` bytes, the strings of the present batch stay.
    """

    def __init__(self, kind: str, limit: int = 12 << 20):
        import pyarrow as pa

        self.limit = limit
        self.names = pa.array([], pa.string())
        self.flat, self.sizes = np.empty(0, kind), np.empty(0, np.int32)

    def ids(self, words, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], step: int = 20_000):
        """Ids of all strings so far in a row, with the place and number of those of each of the distinct `words`.

        `encode` gives the ids of new strings in a row, and how many each has; it gets `step` at most.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(words, value_set=self.names)
        new = words.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.names) + np.arange(len(new))
        flat, sizes = [self.flat], [self.sizes]
        for low in range(0, len(new), step):
            own, each = encode(new.slice(low, step).to_pylist())
            flat.append(own.astype(self.flat.dtype, copy=False))
            sizes.append(each.astype(np.int32))
        self.names = pa.concat_arrays([self.names, new])
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        out = self.flat, starts[at], self.sizes[at].astype(np.int64)
        if (pc.sum(pc.binary_length(self.names)).as_py() or 0) + 8 * len(self.names) + self.flat.nbytes > self.limit:
            self.names, self.flat, self.sizes = words, gathered(*out), self.sizes[at]
        return out
