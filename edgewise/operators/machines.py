"""Factorisation machines fitted over blocks of rows.

The learner goes through its rows object by object, once a round and machine, and keeps them so in
memory. Here rows are packed into blocks of numbers once, and a round adds up the gradients of all
machines in one pass of matrix products over the blocks. Start, gradient, step and stop are the learner's
(AdamW over all rows); figures agree up to the order of additions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import FMRegressionModel, FMRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and rows whose products are made together.
BLOCK, SLICE = 1 << 16, 1 << 13


def _blocks(rows: DataFrame, features: str, labels: Sequence[str], classes: Sequence[bool]) -> DataFrame:
    """`(block)`: each feature of up to BLOCK rows as doubles, then each label; those of `classes` are 0 or 1.

    As the learner's, the fit fails by missing and infinite figures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = [batch.column(f"y{i}").to_numpy(zero_copy_only=False) for i in range(len(labels))]
            if not all(np.isfinite(a).all() for a in (x, *y)):
                raise ValueError("features and labels must be finite numbers")
            if not all(np.isin(a, (0, 1)).all() for a, two in zip(y, classes, strict=True) if two):
                raise ValueError("labels of a classifier must be 0 or 1")
            for low in range(0, batch.num_rows, BLOCK):
                part = slice(low, low + BLOCK)
                yield pa.RecordBatch.from_pydict({"block": pa.array([b"".join(a[part].tobytes() for a in (*x.T, *y))], pa.binary())})

    columns = [F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)]
    return rows.select(vector_to_array(features).alias("x"), *columns).mapInArrow(run, "block binary")


class _Machine:
    """A machine on its way: coefficients are the factors, feature by feature, the linear ones and the intercept."""

    def __init__(self, estimator: FMClassifier | FMRegressor, size: int, jvm):
        self.estimator, self.size, self.k = estimator, size, estimator.getFactorSize()
        self.logistic = isinstance(estimator, FMClassifier)
        self.linear, self.intercept = estimator.getFitLinear(), estimator.getFitIntercept()
        draw = jvm.java.util.Random(estimator.getSeed())
        start = [draw.nextGaussian() * estimator.getInitStd() for _ in range(self.k * size)]
        self.w = np.array(start + [0.0] * (size * self.linear + self.intercept))
        self.m, self.v, self.rounds, self.done = np.zeros(len(self.w)), np.zeros(len(self.w)), 0, False

    def parts(self) -> tuple[np.ndarray, np.ndarray, float]:
        n = self.k * self.size
        linear = self.w[n : n + self.size] if self.linear else np.zeros(self.size)
        return self.w[:n].reshape(self.size, self.k), linear, float(self.w[-1]) if self.intercept else 0.0

    def step(self, gradient: np.ndarray) -> None:
        """A step of AdamW, and whether it was a small one."""
        old, rate, shrink = self.w, self.estimator.getStepSize(), self.estimator.getRegParam()
        self.rounds += 1
        self.m = 0.9 * self.m + (1 - 0.9) * gradient
        self.v = 0.999 * self.v + (1 - 0.999) * gradient * gradient
        mean, square = self.m / (1 - 0.9**self.rounds), self.v / (1 - 0.999**self.rounds)
        self.w = old - (rate * mean / (np.sqrt(square) + 1e-8) + shrink * old)
        small = np.linalg.norm(old - self.w) < self.estimator.getTol() * max(np.linalg.norm(self.w), 1.0)
        # the learner compares from the second step on
        self.done = self.rounds >= self.estimator.getMaxIter() or (self.rounds > 1 and small)

    def model(self, spark):
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        factors, linear, intercept = self.parts()

        def doubles(a: np.ndarray):
            out = gateway.new_array(jvm.double, a.size)
            for i, value in enumerate(a.ravel().tolist()):
                out[i] = value
            return out

        linalg = jvm.org.apache.spark.ml.linalg
        made = (self.estimator.uid, intercept, linalg.DenseVector(doubles(linear)), linalg.DenseMatrix(self.size, self.k, doubles(factors), True))
        ml = jvm.org.apache.spark.ml
        model = FMClassificationModel(ml.classification.FMClassificationModel(*made)) if self.logistic else FMRegressionModel(ml.regression.FMRegressionModel(*made))
        return model.setFeaturesCol(self.estimator.getFeaturesCol()).setPredictionCol(self.estimator.getPredictionCol())


def _gradient(x: np.ndarray, y: np.ndarray, factors: np.ndarray, linear: np.ndarray, intercept: float, logistic: bool) -> np.ndarray:
    """The sum over rows, which are columns of `x`, in the order of the coefficients, with all parts."""
    sums, squares = factors.T @ x, x * x
    raw = intercept + linear @ x + 0.5 * (np.einsum("ij,ij->j", sums, sums) - (factors * factors).sum(axis=1) @ squares)
    with np.errstate(over="ignore"):
        far = 1 / (1 + np.exp(-raw)) - y if logistic else 2 * (raw - y)
    pairs = x @ (sums * far).T - (squares @ far)[:, None] * factors
    return np.concatenate([pairs.ravel(), x @ far, [far.sum()]])


def plain(estimator: FMClassifier | FMRegressor) -> bool:
    """Is this a fit that `fit` does?"""
    return estimator.getSolver() == "adamW" and estimator.getMiniBatchFraction() == 1.0


def fit(rows: DataFrame, estimators: Sequence[FMClassifier | FMRegressor]) -> list[FMClassificationModel | FMRegressionModel]:
    """The models of all estimators over the same features, with one pass over the rows a round."""
    spark, first, labels = rows.sparkSession, estimators[0], len(estimators)
    if not all(plain(e) and e.getFeaturesCol() == first.getFeaturesCol() for e in estimators):
        raise ValueError("AdamW over all rows and one column of features only")
    size = len(rows.select(first.getFeaturesCol()).first()[0])
    machines = [_Machine(e, size, spark._jvm) for e in estimators]
    blocks = _blocks(rows, first.getFeaturesCol(), [e.getLabelCol() for e in estimators], [m.logistic for m in machines]).persist()
    try:
        while at := [i for i, machine in enumerate(machines) if not machine.done]:
            state = [(i, *machines[i].parts(), machines[i].logistic) for i in at]

            def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                sums, n = [0.0] * len(state), 0
                for batch in batches:
                    for value in batch.column("block"):
                        data = np.frombuffer(value.as_buffer()).reshape(size + labels, -1)
                        n += data.shape[1]
                        for low in range(0, data.shape[1], SLICE):
                            part = data[:, low : low + SLICE]
                            for j, (i, *parts) in enumerate(state):
                                sums[j] = sums[j] + _gradient(part[:size], part[size + i], *parts)
                if n:
                    yield pa.RecordBatch.from_pydict({"n": [n], "sums": [np.concatenate(sums).tolist()]})

            # a short list from each task
            found = blocks.mapInArrow(run, "n long, sums array<double>").collect()
            total = sum(r["n"] for r in found)
            if not total:
                break
            sums = np.sum([r["sums"] for r in found], axis=0) / total
            for machine, gradient in zip([machines[i] for i in at], np.split(sums, np.cumsum([(machines[i].k + 1) * size + 1 for i in at])[:-1]), strict=True):
                n = machine.k * size
                kept = [gradient[:n], gradient[n : n + size] if machine.linear else [], gradient[n + size :] if machine.intercept else []]
                machine.step(np.concatenate(kept))
    finally:
        blocks.unpersist()
    return [machine.model(spark) for machine in machines]
