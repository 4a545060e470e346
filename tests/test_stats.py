"""Curves and samples against plain versions."""

import math
import random

import pytest

from edgewise.operators import stats


def plain_areas(rows):
    points, tp, fp = [], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(y for x, y in rows if x == s)
        fp += sum(not y for x, y in rows if x == s)
        points.append((tp, fp))
    p, n = points[-1]
    roc = sum((f - g) * (t + u) / 2 for (t, f), (u, g) in zip(points, [(0, 0), *points])) / (p * n)
    prec = [t / (t + f) for t, f in points]
    pr = sum((t - u) * (a + b) / 2 for (t, _), (u, _), a, b in zip(points, [(0, 0), *points], prec, [prec[0], *prec])) / p
    return roc, pr


@pytest.mark.parametrize("values", [3, 10**6])
def test_areas_equal_the_plain_curve(spark, values):
    rng = random.Random(values)
    rows = [(float(rng.randrange(values)), rng.random() < 0.3) for _ in range(300)]
    df = spark.createDataFrame(rows + [(None, True), (float("nan"), True), (1.0, None)], "s double, y boolean")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # several ranges
    try:
        roc, pr = stats.curve_areas(df, "s", "y").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = plain_areas(rows)
    assert math.isclose(roc, want[0]) and math.isclose(pr, want[1])


def test_areas_without_a_class(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True)], "s double, y boolean")
    assert tuple(stats.curve_areas(rows, "s", "y").first()) == (None, 1.0)
    assert tuple(stats.curve_areas(rows.limit(0), "s", "y").first()) == (None, None)


def test_exact_sizes_of_strata(spark):
    rows = spark.createDataFrame([(i, "abcd"[min(i % 7, 3)], None) for i in range(1000)], "id long, s string, _x int")
    sizes = {r["s"]: r["count"] for r in rows.groupBy("s").count().collect()}
    fractions = {"a": 0.1, "b": 1.0, "c": 0.003, "z": 0.5}
    got = stats.sample_exact(rows, "s", fractions, ["id"], 3)
    assert got.columns == rows.columns
    found = sorted((r["s"], r["id"]) for r in got.collect())
    assert found == sorted((r["s"], r["id"]) for r in stats.sample_exact(rows.repartition(5), "s", fractions, ["id"], 3).collect())
    for s in "abcd":
        assert sum(x == s for x, _ in found) == math.ceil(round(fractions.get(s, 0) * sizes[s], 9))
    assert len(set(found)) == len(found)


def test_copies_follow_the_rate(spark):
    rows = spark.range(4000)
    got = stats.sample_with_replacement(rows, 1.5, ["id"], 1)
    n = got.count()
    assert abs(n - 6000) < 5 * math.sqrt(6000)
    assert got.distinct().count() == n and got.selectExpr("max(copy)").first()[0] > 3
    assert sorted(got.collect()) == sorted(stats.sample_with_replacement(rows.repartition(7), 1.5, ["id"], 1).collect())


def test_tails_of_chi_square():
    for df in range(1, 12):
        for x in (0.1, 1.0, 4.0, 20.0):
            # the density, integrated by trapezoids from x on
            n, top = 200_000, x + 200
            h = (top - x) / n
            density = [math.exp((df / 2 - 1) * math.log(x + i * h) - (x + i * h) / 2 - math.lgamma(df / 2) - df / 2 * math.log(2)) for i in range(0, n + 1, 20)]
            area = 20 * h * (sum(density) - (density[0] + density[-1]) / 2)
            assert abs(stats.chi_square_tail(x, df) - area) < 2e-3
    assert stats.chi_square_tail(0.0, 3) == 1.0


def test_tests_have_p_values(spark):
    rows = spark.createDataFrame([(5.991, 2), (3.841, 1), (None, 1)], "statistic double, df int")
    got = [r["p_value"] for r in stats.with_p_value(rows).collect()]
    assert abs(got[0] - 0.05) < 1e-4 and abs(got[1] - 0.05) < 1e-4 and got[2] is None


def test_figures_of_label_sets(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a"]), ([], []), (["c"], ["b", "c"]), (["a"], [])], "y array<string>, p array<string>")
    got = stats.multilabel_metrics(rows, "y", "p").first()
    assert got["accuracy"] == (0.5 + 1 + 0.5 + 0) / 4 and got["equal_sets"] == 0.25
    assert got["precision"] == (1 + 1 + 0.5 + 0) / 4 and got["recall"] == (0.5 + 1 + 1 + 0) / 4
    assert got["hamming_loss"] == 3 / 12 and got["micro_precision"] == 2 / 3 and got["micro_recall"] == 0.5
    by = {r["label"]: (r["precision"], r["recall"]) for r in stats.multilabel_by_label(rows, "y", "p").collect()}
    assert by == {"a": (1.0, 0.5), "b": (0.0, 0.0), "c": (1.0, 1.0)}
