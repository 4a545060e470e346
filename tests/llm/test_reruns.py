"""Results that must not hang on the run that made them, nor on the order of rows."""

import random

import pytest
from pyspark.sql import functions as F

from edgewise.llm import substrings


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    yield
    spark.conf.set(key, before)


def _texts(seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=80))) for i in range(40)]
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(100 + i, f"x{i} {passage} y{i}") for i in range(6)] + [(102, f"x2 {passage} y2")]
    return rows


def _packed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    keyed = substrings._keyed(docs).select("doc_id", "tie", "text")
    return substrings.pack(keyed, 35, 8, block_chars=1500).collect()


def test_blocks_of_a_second_run_are_those_of_the_first(spark, small_batches):
    rows = _texts()
    first, second = _packed(spark, rows), _packed(spark, rows[::-1])
    assert len({r["block"] for r in first}) > 1
    assert sorted(map(str, first)) == sorted(map(str, second))


def test_ranges_of_two_runs_fit_together(spark, small_batches):
    """What a lost executor leaves: some ranges of the first run, the others of the second."""
    rows = _texts()
    first, second = _packed(spark, rows), _packed(spark, rows)
    schema = "block string, range int, hashes binary, places binary, known binary, docs array<struct<at:long,doc_id:long,tie:long,n_words:long>>"

    def spans(packed):
        frame = spark.createDataFrame(packed, schema)
        return sorted(map(str, substrings.intervals(substrings.repeated(frame), 35).collect()))

    assert len({r["block"] for r in first}) > 1
    mixed = [r for r in first if r["range"] % 2] + [r for r in second if not r["range"] % 2]
    assert spans(mixed) == spans(first)


def test_union_of_span_lists(spark):
    lists = [[[0, 40], [90, 130]], [[30, 50], [130, 140]], [[60, 70]]]
    frame = spark.createDataFrame([(lists,)], "lists array<array<array<long>>>")
    assert frame.select(F.expr(substrings.UNION)).first()[0] == [[0, 50], [60, 70], [90, 140]]
