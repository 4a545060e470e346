"""Models over sessions and rows that are not as the learners like them."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from edgewise.catalog.registry import QUERIES
from edgewise.catalog import model_jobs  # noqa: F401


@pytest.fixture
def lines(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "id as l_orderkey", "id % 20 as l_partkey", "id % 7 as l_suppkey", "1 as l_linenumber", "double(1 + id % 50) as l_quantity",
        "double(100 + 7 * (id % 50)) as l_extendedprice", "(id % 10) / 100D as l_discount", "(id % 8) / 100D as l_tax",
        "array('A', 'N', 'R')[id % 3] as l_returnflag", "if(id % 50 > 25, 'O', 'F') as l_linestatus",
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, n", [("logreg", 3), ("linear_models", 4), ("tune", 4)])
def test_models_after_an_observed_figure(spark, lines, name, n):
    """The session of the rows goes into the tasks with a model's summary; one with observed figures cannot."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    assert len(QUERIES[name](spark, lines).collect()) == n


def test_learners_get_tasks_of_bounded_size(spark, lines, monkeypatch):
    """One row group of a file was one task, of any size."""
    from edgewise.catalog.registry import Tables

    rows = model_jobs._lines(Tables(spark, lines)).coalesce(1)
    with model_jobs._spread(rows) as same:
        assert same is rows
    monkeypatch.setattr(model_jobs, "PART_ROWS", 50)
    monkeypatch.setattr(model_jobs, "FEW_ROWS", 100)
    with model_jobs._spread(rows) as spread:
        assert spread.columns == rows.columns
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 60
        assert sorted(map(str, spread.collect())) == sorted(map(str, rows.collect()))


def test_rows_of_a_search_are_dealt_out_if_one_task_has_most(spark, lines, monkeypatch):
    """A file of one row group was one task in every pass of every fit."""
    from edgewise.catalog.registry import Tables

    rows = model_jobs._lines(Tables(spark, lines)).drop("features").coalesce(1)
    assert model_jobs._evenly(rows) is rows
    monkeypatch.setattr(model_jobs, "FEW_ROWS", 100)
    monkeypatch.setattr(model_jobs, "EVEN_ROWS", 50)
    even = model_jobs._evenly(rows)
    sizes = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 60
    assert sorted(map(str, even.collect())) == sorted(map(str, rows.collect()))
    assert model_jobs._evenly(even) is even


def test_machines_over_blocks_are_those_of_the_learner(spark, lines, monkeypatch):
    """The learner went through all rows object by object, once a round and machine."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.regression import FMRegressor

    from edgewise.catalog.registry import Tables
    from edgewise.operators import machines

    rows = model_jobs._lines(Tables(spark.newSession(), lines)).repartition(3)
    options = {"stepSize": 0.01, "seed": 1}
    jobs = [FMClassifier(maxIter=15, **options), FMRegressor(labelCol="price", maxIter=25, regParam=0.01, factorSize=3, fitIntercept=False, **options)]
    jobs.append(FMRegressor(labelCol="price", maxIter=5, fitLinear=False, tol=0.5, **options))
    due = [job.fit(rows) for job in jobs]
    monkeypatch.setattr(machines, "BLOCK", 50)
    monkeypatch.setattr(machines, "SLICE", 7)
    for want, got in zip(due, machines.fit(rows, jobs), strict=True):
        assert got.intercept == pytest.approx(want.intercept, rel=1e-8)
        assert got.linear.toArray() == pytest.approx(want.linear.toArray(), rel=1e-8)
        assert got.factors.toArray() == pytest.approx(want.factors.toArray(), rel=1e-8)
        a, b = ([r["prediction"] for r in m.transform(rows).select("prediction").collect()] for m in (want, got))
        assert sorted(a) == pytest.approx(sorted(b), rel=1e-8)

    for odd in ("null", "double('inf')"):
        with pytest.raises(Exception, match="finite"):
            machines.fit(rows.withColumn("price", F.expr(f"if(price > 0.3, {odd}, price)")), jobs)
    with pytest.raises(Exception, match="0 or 1"):
        machines.fit(rows.withColumn("label", F.lit(2.0)), jobs)

    def not_called(*_, **__):
        raise AssertionError("fitted object by object")

    few = {r["model"]: r["value"] for r in QUERIES["fm"](spark, lines).collect()}
    for learner in (FMClassifier, FMRegressor):
        monkeypatch.setattr(learner, "_fit", not_called)
    monkeypatch.setattr(model_jobs, "FEW_ROWS", 100)
    assert {r["model"]: r["value"] for r in QUERIES["fm"](spark, lines).collect()} == pytest.approx(few, rel=1e-6)
