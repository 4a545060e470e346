"""Queries: file formats, reader and writer options, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edgewise.catalog.registry import Tables, query
from edgewise.plans.scratch import Scratch
from edgewise.sources import files


def _path(t: Tables) -> str:
    return Scratch(t.spark, "files").path()


def _whole(written, read):
    """`read`, once all its rows and columns have the count and checksum of `written`."""

    def sums(rows):
        row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in written.columns])
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first())

    due, got = sums(written), sums(read)
    if due != got:
        raise ValueError(f"rows and checksum read back are {got}, written were {due}")
    return read


@query(
    "json_read",
    "select event_id, user_id, event_type, cast(props->>'$.k' as bigint) as k from events",
)
def json_read(t: Tables):
    """Nested JSON lines written and read back; the inner object comes from a JSON string."""
    path = _path(t)
    files.parse_json(t.events.select("event_id", "user_id", "event_type", "props"), "props", "k bigint").selectExpr(
        "event_id", "struct(user_id, event_type) as who", "k"
    ).write.json(path)
    return t.spark.read.json(path).select("event_id", "who.user_id", "who.event_type", "k")


@query("csv_read", "select c_custkey, c_name, c_acctbal from customer")
def csv_read(t: Tables):
    path = _path(t)
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True, sep=";")
    read = t.spark.read.csv(path, header=True, sep=";", inferSchema=True)
    return read.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal")


@query(
    "text_read",
    """select c_mktsegment as value, count(*) as n from customer group by 1
       union all select '(gzip lines)', count(*) from customer""",
)
def text_read(t: Tables):
    """Records with their own separator, and gzip-compressed lines."""
    split_path, gzip_path = _path(t), _path(t)
    t.customer.select("c_mktsegment").write.option("lineSep", ";").text(split_path)
    t.customer.select("c_name").write.option("compression", "gzip").text(gzip_path)
    records = files.read_lines(t.spark, split_path, line_sep=";").groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    zipped = files.read_lines(t.spark, gzip_path).agg(
        F.lit("(gzip lines)").alias("value"), F.count(F.lit(1)).alias("n")
    )
    return records.unionByName(zipped)


@query("parquet_rt", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 100000")
def parquet_rt(t: Tables):
    path = _path(t)
    t.orders.write.parquet(path)
    return (
        _whole(t.orders, t.spark.read.parquet(path))
        .where("o_totalprice > 100000")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@query(
    "schema_merge",
    """select p_partkey, p_size * p_size as square, -1 as cube, 1 as key from part
       union all select p_partkey, -1, p_size * p_size * p_size, 2 from part""",
)
def schema_merge(t: Tables):
    path = _path(t)
    t.part.selectExpr("p_partkey", "p_size * p_size as square").write.parquet(f"{path}/key=1")
    t.part.selectExpr("p_partkey", "p_size * p_size * p_size as cube").write.parquet(f"{path}/key=2")
    return files.read_merged(t.spark, path).na.fill(-1, ["square", "cube"])


def _looked_up(rows):
    """The orders of one customer, for which a bloom filter spares files, and all others beside them."""
    one = rows.where("o_custkey = 10").withColumn("looked_up", F.lit(True))
    rest = rows.where("o_custkey is null or o_custkey <> 10").withColumn("looked_up", F.lit(False))
    return one.unionByName(rest).select("o_orderkey", "o_orderpriority", "looked_up")


_LOOKED_UP = "select o_orderkey, o_orderpriority, coalesce(o_custkey = 10, false) as looked_up from orders"


@query("orc_rt", _LOOKED_UP)
def orc_rt(t: Tables):
    path = _path(t)
    files.write_orc_tuned(t.orders, path, "o_custkey", ["o_orderpriority"])
    return _looked_up(_whole(t.orders, t.spark.read.orc(path)))


@query("parquet_opts", _LOOKED_UP)
def parquet_opts(t: Tables):
    path = _path(t)
    files.write_parquet_tuned(t.orders, path, "o_custkey")
    return _looked_up(_whole(t.orders, t.spark.read.parquet(path)))


@query(
    "partitioned",
    "select l_orderkey, l_partkey, l_quantity from lineitem where l_returnflag = 'R'",
)
def partitioned(t: Tables):
    """Written by flag; the filter reads one folder only."""
    path = _path(t)
    t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").write.partitionBy(
        "l_returnflag"
    ).parquet(path)
    return (
        t.spark.read.parquet(path)
        .where("l_returnflag = 'R'")
        .select("l_orderkey", "l_partkey", "l_quantity")
    )


@query(
    "bucketed",
    """select o_orderpriority as priority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1""",
)
def bucketed(t: Tables):
    """Two tables bucketed alike, joined without a shuffle of either."""
    tag, paths = uuid.uuid4().hex[:8], (_path(t), _path(t))
    sides = t.orders.select("o_orderkey", "o_orderpriority"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    buckets = files.bucket_count(*sides)
    orders, lines = (
        files.write_bucketed(side, f"{name}_{tag}", path, buckets, "o_orderkey")
        for side, name, path in zip(sides, ("orders", "lines"), paths, strict=True)
    )
    scratch = Scratch(t.spark, "bucketed")
    counted = scratch.write(
        orders.join(lines, "o_orderkey").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    ).df
    for name, path in zip(("orders", "lines"), paths, strict=True):
        t.spark.sql(f"drop table {name}_{tag}")
        scratch.delete(path)
    return counted


@query("file_filters", "select c_custkey, c_name from customer")
def file_filters(t: Tables):
    """A folder tree of Parquet files with a stray JSON file between them."""
    path = _path(t)
    kept = t.customer.select("c_custkey", "c_name")
    low = F.coalesce(F.col("c_acctbal") < 0, F.lit(False))
    t.customer.where(low).select(*kept.columns).write.parquet(f"{path}/low")
    t.customer.where(~low).select(*kept.columns).write.parquet(f"{path}/deep/high")
    kept.limit(1).write.json(f"{path}/stray")
    return files.read_filtered(
        t.spark,
        path,
        "c_custkey bigint, c_name string",
        ignore_corrupt=True,
        recursive=True,
        modified_after="2000-01-01T00:00:00",
    )


@query(
    "text_whole",
    "select c_mktsegment as segment, count(*) as n_lines, cast(sum(length(c_name)) as bigint) as n_chars from customer group by 1",
)
def text_whole(t: Tables):
    """Whole text files, of 500 lines at most, by name and by time of change; other files are passed over."""
    path = _path(t)
    lines = t.customer.select("c_name", F.col("c_mktsegment").alias("segment"))
    lines.write.option("maxRecordsPerFile", 500).partitionBy("segment").text(path)
    lines.limit(3).select("c_name").write.json(f"{path}/segment=STRAY")
    found = files.read_filtered(
        t.spark, path, "value string, segment string", "text", glob="*.txt", modified_before="2200-01-01T00:00:00", whole=True
    )
    each = found.select("segment", F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("rows"))
    size = F.aggregate("rows", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return each.groupBy("segment").agg(F.sum(F.size("rows")).alias("n_lines"), F.sum(size).alias("n_chars"))


@query("sql_on_file", "select s_suppkey, s_name from supplier where s_acctbal > 0")
def sql_on_file(t: Tables):
    return t.spark.sql(f"select s_suppkey, s_name from parquet.`{t.path('supplier')}` where s_acctbal > 0")


@query(
    "tables",
    """select 'managed' as kind, c_mktsegment as segment, count(*) as n from customer group by 2
       union all select 'external', c_mktsegment, count(*) from customer group by 2
       union all select 'dynamic', c_mktsegment, count(*) filter (where c_mktsegment <> 'BUILDING' or c_acctbal > 0)
       from customer group by 2""",
)
def tables(t: Tables):
    """A managed table, an external one, and one with a single partition replaced."""
    spark, base = t.spark, f"edgewise_{uuid.uuid4().hex[:8]}"
    spark.sql(f"create database {base} location '{_path(t)}'")
    rows = t.customer.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("segment"))
    rows.write.mode("overwrite").saveAsTable(f"{base}.managed")
    outside = _path(t)
    rows.write.parquet(outside)
    spark.sql(f"create table {base}.external using parquet location '{outside}'")
    rows.write.partitionBy("segment").saveAsTable(f"{base}.dynamic")
    files.overwrite_partitions(rows.where("segment = 'BUILDING' and c_acctbal > 0"), f"{base}.dynamic")
    out = None
    for kind in ("managed", "external", "dynamic"):
        counted = (
            spark.table(f"{base}.{kind}")
            .groupBy("segment")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(kind).alias("kind"), "segment", "n")
        )
        out = counted if out is None else out.unionByName(counted)
    scratch = Scratch(spark, "tables")
    kept = scratch.write(out).df
    spark.sql(f"drop database {base} cascade")
    scratch.delete(outside)
    return kept
