"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from edgewise.llm import decontaminate, grammar, imatch, pieces, records, sharding, simhash, substrings, toxicity, wrapper
from edgewise.llm.queries import PIECES, VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie long, component_id string, ids string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "plain words of a short text"), (5, "another text of the same id"),
    (6, "plain words of a short text"), (6, "plain words of a short text"), (7, LONG), (8, LONG + " tail"), (None, "no id"), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 9, "c", "i") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "short text"), (2, None), (3, ""), (4, LONG[:900])], "item_id long, text string")


def jobs(labels, items):
    return {
        "records": lambda d: records.token_records(d, VOCABULARY, 2),
        "decontaminate": lambda d: decontaminate.contamination(d, items),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "imatch": lambda d: imatch.fingerprints(d, parts=3),
        "simhash": lambda d: simhash.near_duplicates(d),
        "grammar": lambda d: grammar.scan(d),
        "substrings": lambda d: substrings.without_repeats(d),
        "pieces": lambda d: pieces.decode(pieces.encode(d, PIECES), PIECES),
        "shards": lambda d: sharding.extendible_shards(d, ["doc_id"], F.octet_length("text"), 1000),
    }


NAMES = ["records", "decontaminate", "toxicity", "imatch", "simhash", "grammar", "substrings", "pieces", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_give_a_row_each(odd, labels, items, name):
    got = jobs(labels, items)[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(empty, labels, items, name):
    assert jobs(labels, items)[name](empty).count() == 0


def test_empty_side_tables(odd, labels, items):
    assert not decontaminate.contamination(odd, items.limit(0)).where("n_hit > 0 or contaminated").count()
    assert not toxicity.toxicity(odd, labels.limit(0)).where("is_toxic").count()


def test_stages_keep_the_columns(odd, labels, items):
    for stage in (
        lambda d: toxicity.without_toxic(d, labels),
        lambda d: simhash.one_of_each(d),
        lambda d: decontaminate.without_contaminated(d, items),
        lambda d: grammar.without_secrets(d),
    ):
        got = stage(odd)
        assert got.columns == odd.columns
        got.collect()


def test_one_of_each_on_ties(odd):
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.one_of_each(odd).collect()), key=str)
    # 1, 2, 3 and the null id share the fingerprint zero; the rows of 6 equal one of 5
    assert [i for i, _ in kept if i in (1, 2, 3)] == [1]
    assert len([1 for i, _ in kept if i == 6]) == 0
    assert (4, "one") in kept


def test_pages(spark):
    rows = [
        (1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "<p>x"), (4, "nothing", "<ul><li>a<li>b</ul>"), (4, "nothing", "plain &amp; bare"),
        (5, "http://a/3", "<article>" + "<p>long " * 5000),
    ]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)))
    text = sorted((r["page_id"], r["text"][:12], r["n_chars"]) for r in got.collect())
    assert text == [(1, "", 0), (2, "", 0), (3, "x", 1), (4, "a\n\nb", 4), (4, "plain & bare", 12), (5, "long\n\nlong\n\n", 29998)]
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
