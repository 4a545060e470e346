"""Edge lists from text files.

Every loader returns `(src, dst)`. Ids that do not parse become null; use
`edges.clean` or `load_report` to drop or count them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src bigint, dst bigint"


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    """Two integer columns with a fixed schema; a bad id is null."""
    return spark.read.csv(path, header=header, sep=sep, schema=EDGE_SCHEMA)


def read_tolerant(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV with any header: first two columns renamed, cast, bad rows dropped."""
    raw = spark.read.csv(path, header=True, sep=sep)
    first, second = (F.col(f"`{c}`").try_cast("bigint") for c in raw.columns[:2])
    return raw.select(first.alias("src"), second.alias("dst")).na.drop()


def read_lines(spark: SparkSession, path: str, sep: str = ",", header: str = "source") -> DataFrame:
    """Raw text lines split on `sep`; lines starting with `header` are skipped."""
    parts = F.split("value", F.lit("\\Q" + sep + "\\E"))
    return (
        spark.read.text(path)
        .where(~F.col("value").startswith(header))
        .select(
            F.trim(F.get(parts, 0)).try_cast("bigint").alias("src"),
            F.trim(F.get(parts, 1)).try_cast("bigint").alias("dst"),
        )
        .na.drop()
    )


def read_strings(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Delimited file without header; ids stay strings."""
    return spark.read.csv(path, sep=sep, schema="src string, dst string")


def read_whitespace(spark: SparkSession, path: str, canonical: bool = False) -> DataFrame:
    """Blank-separated ids, `#` lines skipped; optionally the smaller id first."""
    parts = F.split(F.trim("value"), r"\s+")
    edges = (
        spark.read.text(path)
        .where(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .select(
            F.get(parts, 0).try_cast("bigint").alias("src"),
            F.get(parts, 1).try_cast("bigint").alias("dst"),
        )
        .na.drop()
    )
    if canonical:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return edges


def load_report(raw: DataFrame) -> DataFrame:
    """Rows read, rows with two ids, rows dropped."""
    ok = (F.col("src").isNotNull() & F.col("dst").isNotNull()).cast("bigint")
    return raw.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(ok), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum(1 - ok), F.lit(0)).alias("n_dropped"),
    )
