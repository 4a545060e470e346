"""Grouped, co-grouped and batch functions, with bounded groups.

A pandas group lives in one task. Groups are therefore cut to a bounded size
first; where the semantics need the whole group, built-in aggregates carry
what the pieces have to know of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.scalar import series_count, series_total
from edgewise.plans.skew import join_counted

BLOCK_ROWS = 100_000


def block(rows: DataFrame, on: Sequence[str]) -> Column:
    """A hash block number; blocks hold about BLOCK_ROWS rows each."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return F.pmod(F.xxhash64(*on), F.lit(n))


def total_blocks(rows: DataFrame, key: str, value: str, on: Sequence[str]) -> DataFrame:
    """`(key, block, part)`: sums of `value` by a pandas aggregate, a call for each key and block.

    Only a key of more than BLOCK_ROWS rows is cut, by the hash of `on`: a call costs much more
    than a row, so there should be no more of them than needed.
    """
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    # fewer than the rows by BLOCK_ROWS
    cut = rows.select(key, value, *on).join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("_key")), "left")
    pieces = F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK_ROWS)
    number = F.pmod(F.xxhash64(*on), pieces).cast("int")
    return cut.groupBy(key, number.alias("block")).agg(series_total(value).alias("part"))


def blocked_mean(rows: DataFrame, key: str, value: str, on: Sequence[str]) -> DataFrame:
    """Mean per key by a pandas aggregate over (key, block), merged by built-ins."""
    return (
        rows.withColumn("_block", block(rows, on))
        .groupBy(key, "_block")
        .agg(series_total(value).alias("part"), series_count(value).alias("n"))
        .groupBy(key)
        .agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
        .select(key, "n", (F.col("total") / F.col("n")).alias("mean"))
    )


def over_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Every row with the values of its group, as an unbounded window frame gives them.

    `groups` has one row per key and its row count `n`.
    """
    total = rows.count()
    return join_counted(rows, groups, [key], "n", total)


def subtract_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    """`value` less the mean of its group; the group need not fit one task."""
    means = rows.groupBy(key).agg(F.avg(value).alias("_mean"), F.count(F.lit(1)).alias("n"))
    return (
        over_group(rows, means, key)
        .withColumn(value, F.col(value) - F.col("_mean"))
        .select(*rows.columns)
    )


def grouped_map(
    rows: DataFrame,
    key: str,
    part: Callable[[pd.DataFrame], pd.DataFrame],
    part_schema: str,
    merge: Callable[[DataFrame], DataFrame],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    on: Sequence[str],
) -> DataFrame:
    """A pandas function per group, for groups of any size, in one and the same way.

    Groups are cut into blocks of about BLOCK_ROWS rows by the hash of `on`. `part`
    sums up a block (it groups by `key` itself, many groups at once); `merge` turns
    those sums into one row per key, with the row count `n`; `fn` gets the rows of a
    block together with the row of their key. No task holds a whole large group.
    """
    number = block(rows, on).alias("_block")
    sums = merge(rows.groupBy(number).applyInPandas(part, part_schema))
    return over_group(rows, sums, key).groupBy(number).applyInPandas(fn, schema)


def demean(rows: DataFrame, key: str, value: str, on: Sequence[str]) -> DataFrame:
    """`value` less the mean of its group, by pandas functions."""

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby(key, dropna=False)[value].agg(total="sum", n="count").reset_index()

    def merge(parts: DataFrame) -> DataFrame:
        sums = parts.groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        return sums.select(key, "n", (F.col("total") / F.col("n")).alias("_mean"))

    names = rows.columns

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(**{value: pdf[value] - pdf["_mean"]})[names]

    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return grouped_map(rows, key, part, f"{key} {kind}, total double, n long", merge, fn, schema, on)


def map_batches(rows: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Filter whole Arrow batches with a pandas predicate."""

    def run(batches):
        for pdf in batches:
            yield pdf[keep(pdf)]

    return rows.mapInPandas(run, rows.schema)


def ordered_merge(
    left: DataFrame, right: DataFrame, on: Sequence[str], schema: str
) -> DataFrame:
    """Ordered outer merge of two sides, co-grouped by a hash bucket of `on`.

    Only rows with equal `on` values meet, so hashing all of `on` keeps partners
    together while a busy key is spread over many buckets. `on` should be unique
    per side, as in a keyed time series.
    """
    names, left_names, right_names = list(on), left.columns, right.columns
    buckets = max(1, -(-(left.count() + right.count()) // BLOCK_ROWS))
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("_bucket")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # an empty side comes without columns
        a = a if len(a) else pd.DataFrame(columns=left_names)
        b = b if len(b) else pd.DataFrame(columns=right_names)
        return pd.merge_ordered(a, b, on=names)

    # fresh columns: sides that stem from one table would otherwise share theirs
    sides = [
        d.select(*[F.col(c).alias(c) for c in d.columns]).groupBy(bucket) for d in (left, right)
    ]
    return sides[0].cogroup(sides[1]).applyInPandas(run, schema)
