"""File round trips hold all rows and columns of what was written."""

import pytest

from edgewise.catalog import all_queries
from edgewise.sources import files

DATA = "/root/testdata/sf0.001"


def test_customers_without_a_balance_are_read_back(spark, tmp_path):
    rows = [(1, "a", -5.0), (2, "b", 5.0), (3, "c", None), (4, "d", 0.0)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = all_queries()["file_filters"](spark, str(tmp_path)).collect()
    assert sorted(r["c_custkey"] for r in got) == [1, 2, 3, 4]


@pytest.mark.parametrize("name, writer", [("orc_rt", "write_orc_tuned"), ("parquet_opts", "write_parquet_tuned")])
def test_a_loss_away_from_the_looked_up_key_is_seen(spark, monkeypatch, name, writer):
    all_queries()[name](spark, DATA).collect()
    real = getattr(files, writer)
    monkeypatch.setattr(files, writer, lambda df, *a: real(df.where("o_custkey <> 11"), *a))
    with pytest.raises(ValueError, match="checksum"):
        all_queries()[name](spark, DATA)


def test_all_of_the_parquet_file_is_read(spark):
    assert all_queries()["parquet_rt"](spark, DATA).count()
