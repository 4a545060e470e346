"""Page-view streams: `url, status, zip_code, user_id, at`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.streaming.run import Sink

VIEW_SCHEMA = "url string, status int, zip_code int, user_id bigint, at timestamp"
ERROR_LIMIT = 0.05


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated page views as they arrive in a folder."""
    return spark.readStream.schema(VIEW_SCHEMA).csv(path, sep="\t")


def _spans(rows: DataFrame, size: str, slide: str, delay: str, *keys: str):
    return rows.withWatermark("at", delay).groupBy(F.window("at", size, slide).alias("w"), *keys)


def _flat(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *columns)


def page_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


def sliding_page_counts(rows: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    counted = _spans(rows, size, slide, delay, "url").agg(F.count(F.lit(1)).alias("n"))
    return _flat(counted, "url", "n")


def error_rates(rows: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Share of views per zip code whose status is not 200, flagged above the limit."""
    bad = F.avg(F.when(F.col("status") == 200, 0.0).otherwise(1.0)).alias("rate")
    rated = _spans(rows, size, slide, delay, "zip_code").agg(bad)
    return _flat(rated, "zip_code", "rate", (F.col("rate") > ERROR_LIMIT).alias("flagged"))


def users_seen(rows: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """One row per window and user."""
    return _spans(rows, size, slide, delay, "user_id").agg(F.count(F.lit(1)).alias("n"))


def active_users(rows: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Exact distinct users per window that the watermark has closed."""
    seen = users_seen(rows, size, slide, delay)
    return _flat(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n_users")), "n_users")


def active_users_now(rows: DataFrame, size: str, slide: str, delay: str, sink: Sink) -> DataFrame:
    """Exact distinct users of every window so far, open ones too.

    The stream keeps one row per window and user (complete mode); those of the last batch
    are counted.
    """
    seen = sink.latest(users_seen(rows, size, slide, delay))
    return _flat(seen.groupBy("w").agg(F.count(F.lit(1)).alias("n_users")), "n_users")


def named_users(rows: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """The first `k` users of a batch by id, with their names."""
    return (
        rows.select("user_id").distinct().join(names, "user_id").orderBy("user_id").limit(k)
    )
