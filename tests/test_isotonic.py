"""Isotonic regression in chunks against the minimax formula."""

import random

import pytest

from edgewise.operators import isotonic
from edgewise.plans.scratch import Scratch


def plain(points, rising=True):
    sums = {}
    for x, y, w in points:
        s, v = sums.get(x, (0.0, 0.0))
        sums[x] = s + y * w, v + w
    xs = sorted(sums)
    rows = [sums[x] for x in xs]

    def mean(a, b):
        return sum(r[0] for r in rows[a : b + 1]) / sum(r[1] for r in rows[a : b + 1])

    outer, inner = (max, min) if rising else (min, max)
    return [(x, outer(inner(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1))) for i, x in enumerate(xs)]


@pytest.mark.parametrize("shape", ["noise", "rise", "fall", "drop at the end", "ties"])
def test_fit_equals_the_formula(spark, shape):
    rng = random.Random(shape)
    points = [(float(i // 2), rng.gauss(0, 3), rng.choice([1.0, 2.5])) for i in range(60)]
    points = {
        "noise": points,
        "rise": [(x, x, w) for x, _, w in points],
        "fall": [(x, -x, w) for x, _, w in points],
        "drop at the end": [(x, x, w) for x, _, w in points] + [(99.0, -5000.0, 1.0)],
        "ties": [(x, float(int(x) % 2), w) for x, _, w in points],
    }[shape]
    df = spark.createDataFrame(points + [(None, 1.0, 1.0), (1.0, None, 1.0), (2.0, 5.0, 0.0)], "x double, y double, w double").repartition(3)
    for rising in (True, False):
        want = plain(points, rising)
        for chunk in (4, 1000):
            got = sorted(tuple(r) for r in isotonic.fitted(df.where("y is not null and w > 0"), isotonic.isotonic(df, rising, chunk)).collect())
            assert [x for x, _ in got] == [x for x, _ in want]
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want))


def test_no_chunk_outgrows_its_size(spark):
    rng = random.Random(1)
    points = [(float(i), i + rng.gauss(0, 4), 1.0) for i in range(300)] + [(1000.0, 0.0, 30.0)]
    df = spark.createDataFrame(points, "x double, y double, w double")
    chunks = isotonic.Chunks(df, True, 20, Scratch(spark, "t"))
    seen = [r["n"] for r in chunks.ends()]
    assert len(seen) > 5
    blocks = chunks.settle()
    assert max(r["n"] for r in chunks.ends()) <= 20 and chunks.rounds > 0
    values = [r["total"] / r["weight"] for r in blocks.orderBy("low").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))


def test_no_points(spark):
    none = spark.createDataFrame([], "x double, y double, w double")
    assert isotonic.isotonic(none).count() == 0 and isotonic.fitted(none, isotonic.isotonic(none)).count() == 0
