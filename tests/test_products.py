"""Largest inner products against brute force, and how few items are looked at."""

import numpy as np
import pytest

from edgewise.operators import products

SCHEMA = "id long, x array<double>"


def brute(users, items, k):
    out = []
    for u, x in users:
        scored = sorted((-float(np.dot(x, y)), i) for i, y in items)[:k]
        out += [(u, i, round(-v, 9)) for v, i in scored]
    return sorted(out)


@pytest.mark.parametrize("first,piece", [(1024, 1 << 21), (10, 40)])
def test_products_equal_brute_force(spark, first, piece):
    rng = np.random.default_rng(6)
    users = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(99, [0.0] * 3)]
    items = [(i, (rng.normal(size=3) * rng.exponential()).tolist()) for i in range(150)] + [(200 + i, [1.0, 0.5, 0.0]) for i in range(5)]
    u, i = spark.createDataFrame(users + [(100, None)], SCHEMA).repartition(2), spark.createDataFrame(items + [(999, None)], SCHEMA)
    got = products.largest_products(u, i, 4, first, piece)
    assert sorted((r["user"], r["item"], round(r["product"], 9)) for r in got.collect()) == brute(users, items, 4)


def test_users_leave_when_the_rest_is_too_short(spark):
    items = [(i, [100.0 / (i + 1), 0.0]) for i in range(400)]
    seen = []
    plain = products._meet

    def counted(shared, k, still):
        seen.append(len(shared.value[0]))
        return plain(shared, k, still)

    products._meet = counted
    try:
        got = products.largest_products(spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA), spark.createDataFrame(items, SCHEMA), 3, first=10)
        assert sorted(r["item"] for r in got.collect()) == [0, 1, 2]
    finally:
        products._meet = plain
    assert sum(seen) < 50


def test_few_items_and_none(spark):
    one, none = spark.createDataFrame([(1, [2.0])], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert products.largest_products(one, none, 3).count() == products.largest_products(none, one, 3).count() == 0
    assert [tuple(r) for r in products.largest_products(one, one, 3).collect()] == [(1, 1, 4.0)]
