"""Singular value decomposition of tall and wide matrices, one row per record.

A random range finder: the rows are multiplied by a thin random matrix that is drawn
anew from its seed wherever it is needed, which gives each row a few numbers. An orthonormal
basis of those comes from a QR decomposition of row blocks, whose small triangles are
reduced as a tree. The matrix seen in that basis is thin; its decomposition gives
all factors. With as many numbers as columns the result is exact.

No step needs a square of the number of columns d. With l = k + a few, what is reduced is
l x l, and a round broadcasts the d x l basis of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

#: Numbers beyond the wanted rank, and rounds that sharpen the basis.
EXTRA = 10
POWER = 2
#: Columns whose part of the random matrix is drawn together.
DRAWN = 1024


@dataclass
class Factors:
    """`left(id, u)` and `right(j, v)` with arrays of k entries, and the k singular values."""

    left: DataFrame
    values: np.ndarray
    right: DataFrame


def _random(columns: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rows `columns` of a fixed normal matrix of `width` columns, drawn in blocks."""
    out = np.empty((len(columns), width))
    for block in np.unique(columns // DRAWN):
        drawn = np.random.default_rng([seed, int(block)]).normal(size=(DRAWN, width))
        at = columns // DRAWN == block
        out[at] = drawn[columns[at] % DRAWN]
    return out


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)


def triangle(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """R of the QR decomposition of the rows' arrays: a triangle per task, then of pairs of triangles.

    `width` x `width` numbers are all that leaves a task.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.empty((0, width))
        for pdf in batches:
            if len(pdf):
                held = np.linalg.qr(np.vstack([held, np.array(pdf[column].tolist(), float)]), mode="r")
        yield pd.DataFrame({"part": [0], "r": [held.ravel().tolist()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.empty((0, width))
        for r in pdf.sort_values("part")["r"]:
            held = np.linalg.qr(np.vstack([held, np.asarray(r, float).reshape(-1, width)]), mode="r")
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "r": [held.ravel().tolist()]})

    parts = rows.select(column).mapInPandas(local, "part long, r array<double>").withColumn("part", F.spark_partition_id().cast("long"))
    scratch = Scratch(rows.sparkSession, "triangles")
    parts = scratch.write(parts).df
    while (n := parts.count()) > 16:
        # eight triangles a task, and an eighth of them in the next round
        parts = scratch.write(parts.groupBy(F.floor(F.col("part") / 8).alias("_g")).applyInPandas(lambda g: merge(g).assign(part=lambda x: x["part"] // 8), "part long, r array<double>")).df
        if parts.count() == n:
            break
    held = np.empty((0, width))
    for r in sorted(parts.collect()):
        held = np.linalg.qr(np.vstack([held, np.asarray(r["r"], float).reshape(-1, width)]), mode="r")
    scratch.drop_all()
    return np.vstack([held, np.zeros((max(0, width - len(held)), width))])[:width]


def _solve(r: np.ndarray) -> np.ndarray:
    """What turns rows into orthonormal ones, given their triangle; directions without length become 0."""
    u, s, vt = np.linalg.svd(r)
    keep = s > (s[0] if len(s) else 0) * 1e-13
    return vt.T * np.where(keep, 1 / np.where(keep, s, 1), 0.0)


def _scaled(rows: DataFrame, column: str, by: np.ndarray, schema: str) -> DataFrame:
    """`rows` with the array `column` multiplied by a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(**{column: list(np.array(pdf[column].tolist(), float).reshape(len(pdf), -1) @ by)})

    return rows.mapInPandas(run, schema)


def svd(rows: DataFrame, k: int, seed: int = 0, extra: int = EXTRA, power: int = POWER) -> Factors:
    """The k leading singular values and vectors of `rows(id, x)`, x an array of d numbers.

    Rows are independent of their order up to rounding; vectors are unique up to sign. At most as many
    values as rows or columns are returned. `extra` and `power` sharpen them where k is
    below d; with k = d they are exact. Null arrays are left out.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "svd")
    rows = scratch.write(rows.select("id", F.col("x").cast("array<double>").alias("x")).where("x is not null")).df
    kind = dict(rows.dtypes)["id"]
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    left_schema, right_schema = f"id {kind}, u array<double>", "j int, v array<double>"
    if not n or not d:
        return Factors(spark.createDataFrame([], left_schema), np.empty(0), spark.createDataFrame([], right_schema))
    k = min(k, d, n)
    width = min(k + extra, d)

    def project(source: DataFrame | None) -> DataFrame:
        """`(id, x, u)`: each row times the basis of the columns, random at first."""
        # d x width numbers, cut to what a task multiplies at a time
        basis = None if source is None else spark.sparkContext.broadcast(_dense(source, d, width))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = _random(np.arange(d), width, seed) if basis is None else basis.value
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(u=list(_rows(pdf) @ by))

        return rows.mapInPandas(run, f"id {kind}, x array<double>, u array<double>")

    def across(based: DataFrame) -> DataFrame:
        """`(j, v)`: the matrix turned round, times the basis of the rows; a task adds up its rows first."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((d, width))
            for pdf in batches:
                if len(pdf):
                    total += _rows(pdf).T @ np.array(pdf["u"].tolist(), float)
            yield pd.DataFrame({"j": np.repeat(np.arange(d, dtype=np.int32), width), "i": np.tile(np.arange(width, dtype=np.int32), d), "value": total.ravel()})

        summed = based.mapInPandas(run, "j int, i int, value double").groupBy("j", "i").agg(F.sum("value").alias("value"))
        lists = summed.groupBy("j").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("v"))
        return scratch.write(lists.select("j", F.col("v.value").alias("v"))).df

    full = f"id {kind}, x array<double>, u array<double>"
    columns = None
    for _ in range(power + 1 if width < d else 1):
        based = scratch.write(project(columns)).df
        # twice is enough: the second pass removes what rounding left of the first
        for _ in range(2):
            based = scratch.write(_scaled(based, "u", _solve(triangle(based, "u", width)), full)).df
        columns = across(based)
    # the matrix is based x columns' transpose; that thin factor is decomposed through its own triangle
    r = triangle(columns.select("v"), "v", width)
    inner, values, _ = np.linalg.svd(r.T)
    order = np.argsort(-values)[:k]
    turn, values = inner[:, order], values[order]
    left = scratch.write(_scaled(based.select("id", "u"), "u", turn, left_schema)).df
    inverse = np.where(values > values[0] * 1e-13, 1 / np.where(values > 0, values, 1), 0.0) if values[0] > 0 else np.zeros(k)
    right = scratch.write(_scaled(columns, "v", turn * inverse, right_schema)).df
    return Factors(left, values, right)


def _dense(columns: DataFrame, d: int, width: int) -> np.ndarray:
    """The d x `width` basis as a matrix, orthonormal, for the broadcast of one round."""
    out = np.zeros((d, width))
    for r in columns.toLocalIterator():
        out[r["j"]] = r["v"]
    return np.linalg.qr(out)[0]
