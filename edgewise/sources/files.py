"""File sources and sinks: options that the jobs share.

Thin by design: Spark's readers and writers do the work. What is kept here are
option sets, and the checks a job wants around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_filtered(
    spark: SparkSession,
    path: str,
    schema: str,
    fmt: str = "parquet",
    ignore_corrupt: bool = False,
    recursive: bool = False,
    glob: str | None = None,
    modified_before: str | None = None,
    modified_after: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """Read the files of a folder that pass the given filters; `whole` makes a text file one row."""
    options = {
        "ignoreCorruptFiles": str(ignore_corrupt).lower(),
        "recursiveFileLookup": str(recursive).lower(),
        "pathGlobFilter": glob,
        "modifiedBefore": modified_before,
        "modifiedAfter": modified_after,
        "wholetext": "true" if whole else None,
    }
    given = {k: v for k, v in options.items() if v is not None}
    return spark.read.format(fmt).schema(schema).options(**given).load(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet folders whose files differ in columns: all columns, null where missing."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_parquet_tuned(df: DataFrame, path: str, key: str) -> None:
    """Parquet with a bloom filter on `key`, as large as its distinct values ask for, and page checksums."""
    distinct = df.agg(F.approx_count_distinct(key)).first()[0]
    (
        df.write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, distinct)))
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(path)
    )


def write_orc_tuned(df: DataFrame, path: str, key: str, direct: Sequence[str] = ()) -> None:
    """ORC with a bloom filter on `key`, and `direct` columns without a dictionary."""
    writer = df.write.option("orc.bloom.filter.columns", key)
    if direct:
        writer = writer.option("orc.column.encoding.direct", ",".join(direct))
    writer.orc(path)


def bucket_count(*tables: DataFrame, rows: int = 2_000_000) -> int:
    """Buckets of about `rows` rows of the largest table, a power of two, for tables to be joined by bucket."""
    most = max(df.count() for df in tables)
    return 1 << max(0, (-(-most // rows) - 1).bit_length())


def write_bucketed(
    df: DataFrame, table: str, path: str, buckets: int, key: str, sort: str | None = None
) -> DataFrame:
    """External table bucketed by `key`; later joins on `key` need no shuffle."""
    # one task per bucket, so that each bucket is one file
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(sort or key)
    writer.option("path", path).mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def read_lines(
    spark: SparkSession, path: str, line_sep: str | None = None, whole: bool = False
) -> DataFrame:
    """Text file as `value`: by line, by a given separator, or one row per file."""
    return spark.read.text(path, wholetext=whole, lineSep=line_sep)


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace only those partitions of `table` that `df` holds rows for."""
    spark, setting = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(setting, before)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with the fields of a JSON string column spread out."""
    return df.withColumn("_json", F.from_json(column, schema)).select(
        *[c for c in df.columns if c != column], "_json.*"
    )
