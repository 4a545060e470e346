"""Custom aggregates that combine before the shuffle.

A grouped pandas aggregate gets all values of a group in one task. Here an
aggregate is a buffer instead: every Arrow batch is reduced to one buffer row
per key, and the buffers are merged by built-in aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class MergeableAggregate:
    """`reduce(values)` gives the buffer of a batch; `merge` maps buffer fields to
    aggregate columns; `finish` turns the merged buffer into the result."""

    buffer: T.StructType
    reduce: Callable[[pd.Series], dict]
    merge: dict[str, Column]
    finish: Column

    def __call__(
        self, rows: DataFrame, keys: Sequence[str], value: str, name: str = "result"
    ) -> DataFrame:
        keys, reduce = list(keys), self.reduce
        fields = [f.name for f in self.buffer.fields]
        schema = T.StructType(
            [rows.schema[k] for k in keys] + list(self.buffer.fields)
        )

        def partial(batches):
            for pdf in batches:
                groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
                out = [
                    (*(key if isinstance(key, tuple) else (key,)), *reduce(g[value]).values())
                    for key, g in groups
                ]
                yield pd.DataFrame(out, columns=[*keys, *fields])

        buffers = rows.select(*keys, value).mapInPandas(partial, schema)
        merged = buffers.groupBy(*keys).agg(*[c.alias(n) for n, c in self.merge.items()])
        return merged.select(*keys, self.finish.alias(name))


def average() -> MergeableAggregate:
    """Mean with a (sum, count) buffer; nulls do not count."""
    return MergeableAggregate(
        T.StructType().add("total", T.DoubleType()).add("n", T.LongType()),
        lambda v: {"total": float(v.sum()), "n": int(v.count())},
        {"total": F.sum("total"), "n": F.sum("n")},
        F.col("total") / F.nullif(F.col("n"), F.lit(0)),
    )


def typed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum, average, minimum and maximum by built-in aggregates."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
