import pytest
from pyspark.sql import functions as F

from edgewise.sources import edge_files as L, files


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fixed_schema_keeps_bad_ids_as_null(spark, tmp_path):
    path = put(tmp_path, "e.csv", "source,target\n1,2\nx,3\n4,\n")
    edges = L.read_csv(spark, path)
    assert edges.count() == 3
    report = L.load_report(edges).first()
    assert (report["n_rows"], report["n_valid"], report["n_dropped"]) == (3, 1, 2)


def test_tolerant_and_line_loaders(spark, tmp_path):
    path = put(tmp_path, "e.csv", "source,target\n1,2\nx,3\n4,\n5,6\n")
    assert rows(L.read_tolerant(spark, path)) == [(1, 2), (5, 6)]
    assert rows(L.read_lines(spark, path)) == [(1, 2), (5, 6)]


def test_blank_delimited(spark, tmp_path):
    letters = put(tmp_path, "letters.txt", "A B\nB C\n")
    assert rows(L.read_strings(spark, letters)) == [("A", "B"), ("B", "C")]
    numbers = put(tmp_path, "n.txt", "# note\n2 1\n4\t 1\n\n")
    assert rows(L.read_whitespace(spark, numbers)) == [(2, 1), (4, 1)]
    assert rows(L.read_whitespace(spark, numbers, canonical=True)) == [(1, 2), (1, 4)]


def test_file_filters(spark, tmp_path):
    base = str(tmp_path / "tree")
    spark.range(3).write.parquet(base + "/a")
    spark.range(3, 5).write.parquet(base + "/b/c")
    (tmp_path / "tree" / "a" / "broken.parquet").write_text("not parquet")
    read = files.read_filtered(spark, base, "id bigint", ignore_corrupt=True, recursive=True)
    assert rows(read) == [(0,), (1,), (2,), (3,), (4,)]
    old = files.read_filtered(
        spark, base, "id bigint", recursive=True, modified_before="2000-01-01T00:00:00"
    )
    assert old.count() == 0
    none = files.read_filtered(spark, base, "id bigint", recursive=True, glob="*.orc")
    assert none.count() == 0


def test_text_options(spark, tmp_path):
    path = put(tmp_path, "t.txt", "a,b,c")
    assert rows(files.read_lines(spark, path, line_sep=",")) == [("a",), ("b",), ("c",)]
    assert rows(files.read_lines(spark, put(tmp_path, "w.txt", "x\ny\n"), whole=True)) == [("x\ny\n",)]


def test_json_fields(spark):
    df = spark.createDataFrame([(1, '{"k": 5}')], "id int, props string")
    assert files.parse_json(df, "props", "k int").collect() == [(1, 5)]


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    a = files.write_bucketed(
        spark.range(100).withColumnRenamed("id", "k"), "bucket_a", str(tmp_path / "a"), 4, "k"
    )
    b = files.write_bucketed(
        spark.range(50).withColumnRenamed("id", "k"), "bucket_b", str(tmp_path / "b"), 4, "k"
    )
    joined = a.hint("merge").join(b, "k")
    assert joined.count() == 50
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"drop table {name}")


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "id * 2 as twice", "id % 2 as odd").write.partitionBy("odd").parquet(path)
    plan = (
        spark.read.parquet(path)
        .where((F.col("odd") == 1) & (F.col("id") > 5))
        .select("id")
        ._jdf.queryExecution()
        .executedPlan()
        .toString()
    )
    assert "GreaterThan(id,5)" in plan and "twice" not in plan
    assert "PartitionFilters: [isnotnull(odd" in plan


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from edgewise.plans import scratch

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            return self.value

    class Fake:
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()

        def __init__(self, value):
            self.conf = Conf(value)

    assert scratch.shared_root(Fake("hdfs:///work")) == "hdfs:///work"
    with pytest.raises(ValueError):
        scratch.shared_root(Fake(None))
