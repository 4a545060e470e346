"""Tall matrices stored one row per record (array column)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, column: str, scale=None, sample=None, seed: int = 0) -> DataFrame:
    """Upper triangle of X'X as `(i, j, value)`.

    Each Arrow batch is reduced to one small matrix before the shuffle, so no
    pair of entries of a row is ever emitted. `scale` divides the columns and
    `sample` keeps entries of a column with the given probability.
    """

    def partial(batches):
        from pyspark import TaskContext

        # each task draws numbers of its own
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = None
        for pdf in batches:
            x = np.array(pdf[column].tolist(), dtype=float)
            if not len(x):
                continue
            if sample is not None:
                x = np.where(rng.random(x.shape) < sample, x, 0.0)
            if scale is not None:
                x = x / scale
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})

    parts = rows.select(column).mapInPandas(partial, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def column_cosine(rows: DataFrame, column: str) -> DataFrame:
    """Cosine of every two columns, i < j."""
    products = gram(rows, column)
    norms = products.where("i = j").select("i", F.sqrt("value").alias("norm"))
    return (
        products.where("i < j")
        .join(norms.withColumnRenamed("norm", "norm_i"), "i")
        .join(norms.selectExpr("i as j", "norm as norm_j"), "j")
        .select("i", "j", (F.col("value") / F.col("norm_i") / F.col("norm_j")).alias("cosine"))
    )


def column_cosine_sampled(
    rows: DataFrame, column: str, threshold: float, seed: int = 0
) -> DataFrame:
    """Estimate of `column_cosine`, good for cosines above `threshold`.

    Entries of heavy columns are sampled: the longer the column, the smaller the
    share that is kept, and the estimate is scaled to stay unbiased.
    """
    squares = rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(
        F.sqrt(F.sum(F.col("x").cast("double") * F.col("x"))).alias("norm")
    )
    norms = np.array([r["norm"] for r in squares.orderBy("i").collect()])  # one per column
    gamma = math.sqrt(10 * math.log(len(norms)) / threshold)
    keep = np.minimum(1.0, gamma / norms)
    estimate = gram(rows, column, scale=np.minimum(gamma, norms), sample=keep, seed=seed)
    return estimate.where("i < j").withColumnRenamed("value", "cosine")


def singular_values(rows: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values and right vectors; the driver sees d x d numbers."""
    entries = gram(rows, column).toPandas()
    d = int(entries["j"].max()) + 1
    full = np.zeros((d, d))
    full[entries["i"], entries["j"]] = entries["value"]
    full = np.triu(full) + np.triu(full, 1).T
    values, vectors = np.linalg.eigh(full)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
