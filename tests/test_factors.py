"""Factors against the dense decomposition."""

import numpy as np
import pytest

from edgewise.operators import factors


def table(spark, a, parts=3):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)] + [(-1, None)], "id long, x array<double>").repartition(parts)


def dense(found, n, d):
    u, v = np.zeros((n, len(found.values))), np.zeros((d, len(found.values)))
    for r in found.left.collect():
        u[r["id"]] = r["u"]
    for r in found.right.collect():
        v[r["j"]] = r["v"]
    return u, v


@pytest.mark.parametrize("shape,parts", [((200, 12), 3), ((200, 12), 20), ((8, 30), 3)])
def test_all_factors_give_the_matrix_back(spark, shape, parts):
    a = np.random.default_rng(2).normal(size=shape)
    found = factors.svd(table(spark, a, parts), k=min(shape))
    u, v = dense(found, *shape)
    assert np.allclose(u.T @ u, np.eye(min(shape)), atol=1e-9) and np.allclose(v.T @ v, np.eye(min(shape)), atol=1e-9)
    assert np.allclose(u * found.values @ v.T, a, atol=1e-8)
    assert np.allclose(found.values, np.linalg.svd(a)[1], atol=1e-8)


def test_leading_factors_of_a_wide_matrix(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(150, 6)) @ np.diag([50, 30, 20, 10, 5, 3.0]) @ rng.normal(size=(6, 90)) + 0.01 * rng.normal(size=(150, 90))
    found = factors.svd(table(spark, a), k=4)
    u, v = dense(found, 150, 90)
    left, values, right = np.linalg.svd(a)
    assert np.allclose(found.values, values[:4], rtol=1e-6)
    assert np.allclose(np.abs((u * left[:, :4]).sum(axis=0)), 1, atol=1e-6)
    assert np.allclose(np.abs((v * right[:4].T).sum(axis=0)), 1, atol=1e-6)


def test_ranks_below_the_columns_and_no_rows(spark):
    a = np.outer(np.arange(1.0, 21), np.arange(1.0, 6))
    found = factors.svd(table(spark, a), k=5)
    u, v = dense(found, 20, 5)
    assert np.allclose(u * found.values @ v.T, a) and np.allclose(found.values[1:], 0, atol=1e-8)
    none = factors.svd(table(spark, a).limit(0), k=2)
    assert none.left.count() == none.right.count() == len(none.values) == 0


def test_triangles_of_many_tasks(spark):
    a = np.random.default_rng(5).normal(size=(400, 4))
    r = factors.triangle(table(spark, a, 40).where("x is not null"), "x", 4)
    assert np.allclose(r.T @ r, a.T @ a)
