import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgewise.functions import aggregators, grouped
from edgewise.operators import matrix, similarity, stats, text
from edgewise.plans import skew


def test_log_lines(spark):
    line = '10.0.0.1 - {u} [02/Feb/2025:10:00:00 +0000] "GET /a HTTP/2" 200 {b} "ref" "agent" more'
    lines = [line.format(u='"ada"', b=120), line.format(u='"ada"', b=80), line.format(u='"-"', b=7), "junk"]
    rows = text.log_stats(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r["user"]: (r["bytes"], r["n"]) for r in rows} == {'"ada"': (200, 2), None: (7, 2)}


def test_words_and_numbers(spark):
    lines = spark.createDataFrame([("b a b",), ("10 9 x -3",)], "value string")
    assert {r["word"]: r["n"] for r in text.word_count(lines).collect()}["b"] == 2
    assert [r[0] for r in text.sorted_integers(lines).collect()] == [-3, 9, 10]
    assert text.line_lengths(lines).first() == (2, 14)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_exclude_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(text, "MAX_BROADCAST_WORDS", limit)
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "word string")
    kept, counts = text.exclude(rows, spark.createDataFrame([("a",)], "word string"))
    assert kept.collect() == [("b",)] and counts.first() == (1, 2)


def test_distinct_with_low_hot_and_cold(spark, hot_keys):
    rng = random.Random(3)
    pairs = [(rng.choice([1, 1, 1, 2, 3, 4]), rng.randrange(9)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "k bigint, v bigint")
    low = {k: min(v for q, v in pairs if q == k) for k, _ in pairs}
    found = skew.distinct_with_low(rows, ["k"], "v", len(pairs)).collect()
    assert sorted((r["k"], r["v"], r["low"]) for r in found) == sorted((k, v, low[k]) for k, v in set(pairs))


def test_joins_on_hot_keys(spark, hot_keys):
    pairs = [(0, i) for i in range(40)] + [(i, i) for i in range(1, 10)]
    rows = spark.createDataFrame(pairs, "k bigint, v bigint")
    counts = rows.groupBy("k").count().selectExpr("k", "k * 10 as x", "count as n")
    joined = skew.join_counted(rows, counts, ["k"], "n", len(pairs)).collect()
    assert sorted(tuple(r) for r in joined) == sorted((k, v, k * 10) for k, v in pairs)
    keyed = skew.KeyedRows(rows, ["k"])
    assert keyed.hot_keys is not None
    assert keyed.join(counts.drop("n")).count() == len(pairs)
    twice = counts.drop("n").union(counts.drop("n"))
    assert keyed.join_many(twice).count() == 2 * len(pairs)
    keyed.release()


def test_salted_aggregation(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 as k")
    out = skew.salted_agg(
        rows, ["k"], ["id"], [F.sum("id").alias("s")], [F.sum("s").alias("s")], salts=8
    )
    assert {r["k"]: r["s"] for r in out.collect()} == {
        k: sum(i for i in range(1000) if i % 3 == k) for k in range(3)
    }


def test_custom_average_merges_batches(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    found = aggregators.average()(rows.repartition(3), ["k"], "v").collect()
    assert {r["k"]: r["result"] for r in found} == {"a": 2.0, "b": None}


@pytest.mark.parametrize("size", [100_000, 2])
def test_grouped_map_does_not_depend_on_the_block_size(spark, monkeypatch, size):
    monkeypatch.setattr(grouped, "BLOCK_ROWS", size)
    rows = spark.createDataFrame([(7, 4.0), (7, 8.0), (9, 1.0), (9, 2.0), (9, 9.0)], "id bigint, v double")
    out = grouped.demean(rows, "id", "v", ["id", "v"])
    assert sorted(tuple(r) for r in out.collect()) == [(7, -2.0), (7, 2.0), (9, -3.0), (9, -2.0), (9, 5.0)]


def test_long_chain_needs_no_round_limit(spark):
    from edgewise.operators.components import connected_components

    path = spark.range(60).selectExpr("id as src", "id + 1 as dst")
    for algorithm in ("star", "minlabel"):
        found = connected_components(path, algorithm)
        assert found.converged and found.labels.where("component <> 0").count() == 0


def test_summary_keeps_graphs_without_edges(spark):
    from edgewise.operators.components import summary

    rows = spark.createDataFrame([("a", 1, 2), (None, 3, 4), ("b", 5, None)], "g string, src bigint, dst bigint")
    found = {r["g"]: (r["n_nodes"], r["n_edges"], r["n_components"]) for r in summary(rows, by=["g"]).collect()}
    assert found["a"] == (2, 1, 1) and found["b"] == (0, 0, 0) and None in found


def test_multiclass_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    got = {r["label"]: (r["precision"], r["recall"]) for r in stats.multiclass_metrics(rows, "y", "p").collect()}
    assert got["a"] == (0.5, 0.5) and got["b"] == (0.5, 1.0) and got["c"] == (0.0, 0.0)


def test_merged_moments_keep_their_digits(spark):
    from edgewise.streaming.learning import merge_moments

    parts = spark.createDataFrame([(True, 2, 1e9, 0.5), (True, 2, 1e9 + 1, 0.5)], "grp boolean, n bigint, mean double, m2 double")
    assert merge_moments(parts).first()["m2"] == pytest.approx(2.0)


def test_ordered_merge(spark):
    left = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "time bigint, id bigint, v1 double")
    right = spark.createDataFrame([(1, 1, "x"), (3, 2, "y")], "time bigint, id bigint, v2 string")
    out = grouped.ordered_merge(
        left, right, ["time", "id"], "time bigint, id bigint, v1 double, v2 string"
    ).collect()
    assert sorted((r["time"], r["id"], r["v1"], r["v2"]) for r in out if r["v1"] is not None) == [
        (1, 1, 1.0, "x"), (1, 2, 2.0, None), (2, 1, 3.0, None),
    ]
    assert len(out) == 4


def test_column_cosine_exact_and_sampled(spark):
    rng = random.Random(5)
    data = [([a := rng.random(), a + rng.random() / 10, rng.random()],) for _ in range(400)]
    rows = spark.createDataFrame(data, "v array<double>").repartition(3)
    frame = pd.DataFrame([d[0] for d in data])
    norm = frame / (frame**2).sum() ** 0.5
    want = norm.T @ norm
    exact = {(r["i"], r["j"]): r["cosine"] for r in matrix.column_cosine(rows, "v").collect()}
    near = {(r["i"], r["j"]): r["cosine"] for r in matrix.column_cosine_sampled(rows, "v", 0.1).collect()}
    for pair in ((0, 1), (0, 2), (1, 2)):
        assert exact[pair] == pytest.approx(want.loc[pair], abs=1e-9)
        assert near[pair] == pytest.approx(want.loc[pair], abs=0.2)
    values, _ = matrix.singular_values(rows, "v", 2)
    import numpy as np

    assert values == pytest.approx(np.linalg.svd(frame.values)[1][:2])


def test_near_duplicate_clusters(spark):
    base = " ".join(f"w{i}" for i in range(40))
    docs = [(1, base), (2, base), (3, base + " extra"), (4, " ".join(f"z{i}" for i in range(40))), (5, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = similarity.near_duplicate_clusters(frame, "doc_id", "text", 0.3).labels.collect()
    assert {r["node"]: r["component"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_metrics(spark):
    rows = spark.createDataFrame(
        [(True, True), (True, False), (False, True), (False, False)], "y boolean, p boolean"
    )
    assert stats.binary_metrics(rows, "y", "p").first()["accuracy"] == 0.5
    errors = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    row = stats.regression_metrics(errors, "y", "p").first()
    assert (row["mse"], row["mae"], row["r2"]) == (0.5, 0.5, 0.5)
    sets = spark.createDataFrame([(["a", "b"], ["a"]), (["c"], ["c", "d"])], "y array<string>, p array<string>")
    multi = stats.multilabel_metrics(sets, "y", "p").first()
    assert (multi["accuracy"], multi["precision"], multi["recall"]) == (0.5, 0.75, 0.75)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame(
        [(["a", "b", "c"], ["a", "c"]), (["a", "b", "c"], ["z"])], "p array<string>, r array<string>"
    )
    row = stats.ranking_metrics(rows, "p", "r", 3).first()
    assert row["precision"] == pytest.approx((2 / 3 + 0) / 2)
    assert row["recall"] == pytest.approx(0.5)
    assert row["map"] == pytest.approx((1 + 2 / 3) / 2 / 2)
    assert row["ndcg"] == pytest.approx((1 + 0.5) / (1 + 0.6309297535714575) / 2)


def test_chi_square_and_samples(spark):
    counts = spark.createDataFrame([(10,), (20,), (30,)], "n bigint")
    assert stats.goodness_of_fit(counts, "n").first() == (10.0, 2)
    rows = spark.range(2000).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as s")
    part = stats.sample_strata(rows, "s", {"a": 0.5}, ["id"], 1)
    n = part.count()
    assert 400 < n < 600 and part.where("s = 'b'").count() == 0
    again = stats.sample_strata(rows.repartition(5), "s", {"a": 0.5}, ["id"], 1)
    assert again.count() == n
    assert stats.sample_fixed(rows, 7, ["id"]).count() == 7


def test_a_pandas_aggregate_is_called_once_a_small_key(spark, monkeypatch):
    rows = spark.range(3_000).selectExpr("id as at", "if(id < 2900, id % 290, if(id < 2990, null, -1)) as k", "double(id) as v")
    monkeypatch.setattr(grouped, "BLOCK_ROWS", 50)
    blocks = grouped.total_blocks(rows, "k", "v", ["at"])
    calls = {r["k"]: r["n"] for r in blocks.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert calls.pop(None) == 2 and set(calls.values()) == {1}  # 90 rows without a key
    total = {r["k"]: r["s"] for r in blocks.groupBy("k").agg(F.sum("part").alias("s")).collect()}
    assert total == {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.sum("v").alias("s")).collect()}


def test_table_functions_send_rows(spark):
    """A batch for each call took longer than the rows of the call."""
    from pyspark.util import PythonEvalType

    from edgewise.functions import tablefunctions as tf

    assert tf.Instalments.evalType == tf.Sentences.evalType == PythonEvalType.SQL_TABLE_UDF
    tf.register_table_functions(spark)
    found = spark.sql("select p.n, i.* from values (1000L, 3), (null, 2), (7L, null), (5L, 0) p(c, n), lateral instalments(c, n) i").collect()
    assert [tuple(r) for r in found] == [(3, 1, 333), (3, 2, 333), (3, 3, 334)]
