"""From raw documents to token ids: the stages of the corpus pipeline, in order.

Each stage takes the documents its predecessor kept and is written as Parquet before
the next one reads it. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgewise import session
from edgewise.llm import decontaminate, grammar, pieces, simhash, toxicity
from edgewise.llm.base import table
from edgewise.llm.queries import PIECES
from edgewise.plans.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not judge toxic."""
    return toxicity.without_toxic(docs, table(session.tune(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in a benchmark passage."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `[secret]` in the place of credentials and n_chars counted anew."""
    return grammar.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with its id, language and source."""
    return pieces.encode(docs, PIECES).select("doc_id", "lang", "source", "ids", "n_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: The first stage is a trained model, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for all of `documents`."""
    scratch = Scratch(session.tune(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir)).df
    return docs
