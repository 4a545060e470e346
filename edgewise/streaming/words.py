"""Streams of text lines. Each job takes a streaming DataFrame with `value`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators import text
from edgewise.streaming.run import Sink


def as_text(stream: DataFrame) -> DataFrame:
    """Message streams deliver `value` as binary."""
    return stream.withColumn("value", F.col("value").cast("string"))


def running_counts(lines: DataFrame) -> DataFrame:
    """Word counts so far; for complete or update mode."""
    return text.word_count(as_text(lines))


def windowed_counts(
    rows: DataFrame, time: str, key: str, size: str, slide: str | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """Rows per key and tumbling or sliding window; the slide defaults to the size."""
    slide = slide or size
    spans = [pd.Timedelta(s) for s in (size, slide)]
    if spans[1] > spans[0]:
        raise ValueError("the slide must not exceed the window")
    return (
        rows.withWatermark(time, delay)
        .groupBy(F.window(time, size, slide).alias("window"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Word scores, separated by a tab."""
    return spark.read.csv(path, sep="\t", schema="word string, score bigint")


def top_scored(lines: DataFrame, scores: DataFrame, sink: Sink, k: int = 5) -> DataFrame:
    """Per batch: score times count of each scored word, the `k` highest."""

    def each(rows: DataFrame, batch: int) -> DataFrame:
        counted = text.word_count(rows)
        return (
            counted.join(scores, "word")
            .select("word", (F.col("score") * F.col("n")).alias("weight"))
            .orderBy(F.desc("weight"), "word")
            .limit(k)
        )

    return sink.batches(lines, each)


def batch_counts(lines: DataFrame, sink: Sink) -> DataFrame:
    """Word counts of each micro-batch by itself."""
    return sink.batches(lines, lambda rows, batch: text.word_count(rows))


def sql_counts(lines: DataFrame, sink: Sink) -> DataFrame:
    """The same in SQL over a view of the batch."""

    def each(rows: DataFrame, batch: int) -> DataFrame:
        text.words(rows).createOrReplaceTempView("edgewise_words")
        return rows.sparkSession.sql("select word, count(*) as n from edgewise_words group by word")

    return sink.batches(lines, each)


def filtered_counts(lines: DataFrame, excluded: DataFrame, sink: Sink) -> DataFrame:
    """Per batch, how many words were kept and dropped; resumes from the checkpoint."""
    return sink.batches(lines, lambda rows, batch: text.exclude(text.words(rows), excluded)[1])


def matching_lines(streams: list[DataFrame], needle: str, sink: Sink) -> DataFrame:
    """Lines of all streams that contain `needle`, counted per batch."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    hits = merged.where(F.col("value").contains(needle))
    return sink.batches(hits, lambda rows, batch: rows.agg(F.count(F.lit(1)).alias("n")))


def remainder_counts(rows: DataFrame, column: str, modulus: int, sink: Sink) -> DataFrame:
    """Rows per remainder of `column`, per batch."""
    rest = F.pmod(F.col(column), F.lit(modulus)).alias("remainder")
    return sink.batches(
        rows, lambda part, batch: part.groupBy(rest).agg(F.count(F.lit(1)).alias("n"))
    )
