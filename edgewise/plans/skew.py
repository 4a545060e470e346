"""Joins on keys of which one may hold a large share of all rows.

A key with more than `total / MAX_HOT_KEYS` rows is hot, so there are fewer
than MAX_HOT_KEYS of them whatever the data looks like. Their side of the join
is therefore small enough to broadcast, and their rows stay where they are,
spread over all tasks. All other keys have bounded groups and take a shuffle
join. No row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 100_000
MIN_HOT_ROWS = 1_000_000
#: Share of all rows from which on frequent values are listed in one pass without a shuffle.
LEAST_SUPPORT = 1e-3


def hot_limit(total: int, max_hot: int | None = None) -> int:
    """Rows above which a key counts as hot."""
    return max(MIN_HOT_ROWS, total // (max_hot or MAX_HOT_KEYS))


def join_counted(
    rows: DataFrame,
    lookup: DataFrame,
    key: Sequence[str],
    count: str,
    total: int,
    max_hot: int | None = None,
) -> DataFrame:
    """Inner join of `rows` to `lookup`, which has one row per key.

    `lookup[count]` is the number of `rows` with that key, or an upper bound of
    it; its sum over all keys is at most `total`. Lower `max_hot` for wide
    lookup rows: that many of them may be broadcast.
    """
    key = list(key)
    if total <= MIN_HOT_ROWS:
        return rows.join(lookup.drop(count), key)
    limit = hot_limit(total, max_hot)
    hot = lookup.where(F.col(count) > limit).drop(count)
    cold = lookup.where(F.col(count) <= limit).drop(count)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    )


def distinct_with_low(
    rows: DataFrame, key: Sequence[str], value: str, total: int, extra: str | None = None
) -> DataFrame:
    """Distinct `(key, value)` rows with `low`, the smallest value of the key.

    `total` bounds the row count. Cold keys take one shuffle and one sort, which
    serve the minimum and the duplicate removal together. Hot keys get their
    minimum from a combining aggregate and a broadcast, and their duplicates are
    removed by hashing key and value. `extra` is kept at its largest value.
    """
    key = list(key)
    more = [extra] if extra else []
    if total <= MIN_HOT_ROWS:
        return _sorted_low(rows, key, value, more)
    limit = hot_limit(total)
    suspects = rows
    if limit / total >= LEAST_SUPPORT:
        # every value with that share of the rows is in this short list, which costs no shuffle;
        # a hot key has a frequent value in its last column
        found = rows.freqItems([key[-1]], min(1.0, limit / total)).first()[0]
        suspects = rows.where(F.col(key[-1]).isin(found)) if found else rows.limit(0)
    hot = (
        suspects.groupBy(*key)
        .agg(F.min(value).alias("low"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .drop("_n")
    )
    # fewer than MAX_HOT_KEYS rows; mostly there are none and the plain path is enough
    listed = hot.collect()
    if not listed:
        return _sorted_low(rows, key, value, more)
    hot = F.broadcast(rows.sparkSession.createDataFrame(listed, hot.schema))
    thin = (
        rows.join(F.broadcast(hot.select(*key)), key, "left_semi")
        .groupBy(*key, value)
        .agg(*[F.max(c).alias(c) for c in more] or [F.count(F.lit(1)).alias("_n")])
        .select(*key, value, *more)
    )
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return _sorted_low(cold, key, value, more).unionByName(thin.join(hot, key))


def _sorted_low(rows: DataFrame, key: list[str], value: str, more: list[str]) -> DataFrame:
    order = ", ".join([value, *[f"{c} desc" for c in more]])
    by_value = f"(partition by {', '.join(key)} order by {order})"
    return (
        rows.selectExpr(
            *key,
            value,
            *more,
            f"first({value}) over {by_value} as low",
            f"lag({value}) over {by_value} as _prev",
        )
        .where(f"_prev is null or _prev <> {value}")
        .drop("_prev")
    )


class KeyedRows:
    """Fixed rows joined to a changing per-key state, round after round.

    The cold rows are cached hash-partitioned and sorted by the key, so a round
    shuffles and sorts the state only. The cache is rebuilt from the source if an
    executor is lost.
    """

    def __init__(self, rows: DataFrame, key: Sequence[str], total: int | None = None):
        self.key = list(key)
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.total = rows.count() if total is None else total
        self.hot_keys = None
        self.hot_rows = None
        cold = rows
        if self.total > MIN_HOT_ROWS:
            limit = hot_limit(self.total)
            found = rows.groupBy(*self.key).count().where(F.col("count") > limit)
            # fewer than MAX_HOT_KEYS rows by the choice of the limit
            listed = found.select(*self.key).collect()
            if listed:
                schema = rows.select(*self.key).schema
                self.hot_keys = F.broadcast(spark.createDataFrame(listed, schema))
                self.hot_rows = rows.join(self.hot_keys, self.key, "left_semi").persist(
                    StorageLevel.MEMORY_AND_DISK
                )
                cold = rows.join(self.hot_keys, self.key, "left_anti")
        self.cold_rows = (
            cold.repartition(parts, *self.key)
            .sortWithinPartitions(*self.key)
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

    def join(self, state: DataFrame, how: str = "inner") -> DataFrame:
        """Rows with the state of their key; `state` has one row per key."""
        out = self.cold_rows.join(state, self.key, how)
        if self.hot_keys is not None:
            small = F.broadcast(state.join(self.hot_keys, self.key, "left_semi"))
            out = out.unionByName(self.hot_rows.join(small, self.key, how))
        return out

    def join_many(self, state: DataFrame) -> DataFrame:
        """As `join`, for a state with several rows per key.

        The state of a hot key has no size bound, so it is not broadcast: the
        hot rows are spread over salts and the state is repeated once per salt.
        """
        out = self.cold_rows.join(state, self.key)
        if self.hot_keys is not None:
            salts = 64
            spread = self.hot_rows.withColumn(
                "_salt", F.pmod(F.xxhash64(*self.hot_rows.columns), F.lit(salts)).cast("int")
            )
            copies = state.join(self.hot_keys, self.key, "left_semi").withColumn(
                "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
            )
            out = out.unionByName(spread.join(copies, [*self.key, "_salt"]).drop("_salt"))
        return out

    def release(self) -> None:
        self.cold_rows.unpersist()
        if self.hot_rows is not None:
            self.hot_rows.unpersist()


def salted_agg(
    df: DataFrame,
    keys: Sequence,
    salt_on: Sequence[str],
    partial: Sequence,
    final: Sequence,
    final_keys: Sequence[str] | None = None,
    salts: int = 64,
) -> DataFrame:
    """Two-step aggregation: by key and salt first, then by key.

    For aggregates whose partial state does not shrink before the shuffle; the
    salt spreads a hot key over `salts` groups. `partial` and `final` are lists
    of aliased aggregate columns.
    """
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
    return (
        df.groupBy(*keys, salt.alias("_salt")).agg(*partial).groupBy(*(final_keys or keys)).agg(*final)
    )
