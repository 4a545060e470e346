"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. The model of a category sees the
words of a document, two figures of its form, and the probabilities of all earlier
categories. For training, those probabilities come from models that did not see
the row (out-of-fold), so that later models learn to trust them as much as they
deserve on new text; for new text they come from the model of all rows.

Each model is a logistic regression with an L1 penalty over the presence of words,
which keeps few of them. The models are fitted on `EXAMPLES` labelled rows at most,
those with the smallest hashes of their doc_id; the fits of a category (one per fold, one on
all rows) run side by side, each in a task with that bounded sample. Scoring covers
every row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

EXAMPLES = 20_000
FOLDS = 3
#: Places of the words of the sample, by their hash. Two words in one place share a weight.
TERMS = 1 << 20
#: A place in fewer rows of the sample is no evidence; all others are columns of the fits.
MIN_DOCS = 4
PENALTY = 0.002
ROUNDS = 250
THRESHOLD = 0.5

WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> tuple[set[str], float, float]:
    """Distinct lower-cased words, log length and share of characters outside words."""
    text = text if isinstance(text, str) else ""
    found = WORD.findall(text.lower())
    letters = sum(map(len, found))
    return set(found), math.log1p(len(text)), max(0.0, 1 - letters / len(text)) if text else 0.0


@dataclass
class Linear:
    """Weights of words by name, of the dense columns in order, and the intercept."""

    words: dict[str, float]
    dense: list[float]
    intercept: float

    def probability(self, words: set[str], dense: Sequence[float]) -> float:
        total = self.intercept + sum(a * b for a, b in zip(self.dense, dense, strict=True))
        # fsum: the order in which a set is met must not show
        total += math.fsum(self.words[w] for w in words & self.words.keys())
        return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def fit_linear(
    at: np.ndarray, sizes: np.ndarray, dense: np.ndarray, y: np.ndarray, terms: int, penalty: float, rounds: int
) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with an L1 penalty: word weights, dense weights, intercept.

    Row i has the words `at[sum(sizes[:i]):][:sizes[i]]`. Accelerated proximal gradient
    steps with a step length of its own for each column; the penalty is on columns of
    unit variance, the intercept has none.
    """
    n, d = dense.shape
    mean, spread = dense.mean(axis=0), dense.std(axis=0)
    spread[spread < 1e-9] = 1.0
    dense = (dense - mean) / spread
    starts = np.cumsum(sizes) - sizes
    filled = np.flatnonzero(sizes)
    share = np.bincount(at, minlength=terms) / n
    # bound of the curvature of each column: its entries times the row sums of absolute values
    reach = sizes + np.abs(dense).sum(axis=1) + 1.0
    steep = np.concatenate(
        [np.bincount(at, np.repeat(reach, sizes), minlength=terms), np.abs(dense).T @ reach, [reach.sum()]]
    )
    step = 4 * n / np.maximum(steep, 1e-9)
    cost = np.concatenate([penalty * np.sqrt(share * (1 - share)), np.full(d, penalty), [0.0]])
    w = np.zeros(terms + d + 1)
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[-1] = math.log(rate / (1 - rate))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        margin = dense @ z[terms:-1] + z[-1]
        if len(filled):
            margin[filled] += np.add.reduceat(z[at], starts[filled])
        wrong = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y) / n
        slope = np.concatenate([np.bincount(at, np.repeat(wrong, sizes), minlength=terms), dense.T @ wrong, [wrong.sum()]])
        moved = z - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * cost, 0)
        if ((z - new) * (new - w)).sum() > 0:  # overshot: start the acceleration anew
            t = 1.0
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        change = np.abs(new - w).max()
        z, w, t = new + (t - 1) / after * (new - w), new, after
        if change < 1e-5:
            break
    weights = w[terms:-1] / spread
    return w[:terms], weights, float(w[-1] - (weights * mean).sum())


class Chain:
    """Fitted models in order."""

    def __init__(self, categories: Sequence[str], models: list[Linear]):
        self.categories, self.models = list(categories), models

    def probabilities(self, text: str | None) -> list[float]:
        words, *dense = features(text)
        out: list[float] = []
        for model in self.models:
            out.append(model.probability(words, [*dense, *out]))
        return out

    def score(self, docs: DataFrame) -> DataFrame:
        """`docs` with `p_<category>` columns; null and empty texts are scored as texts without words.

        Columns of these names are replaced, all others kept.
        """
        names = [f"p_{c}" for c in self.categories]
        kept = docs.drop(*names)
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            chain = shared.value
            for texts in batches:
                yield pd.DataFrame([chain.probabilities(t) for t in texts], columns=names, dtype=float)

        found = F.pandas_udf(run, ", ".join(f"`{n}` double" for n in names))("text")
        scored = kept.withColumn("_tox_p", found)
        return scored.select(*kept.columns, *[F.col("_tox_p")[n].alias(n) for n in names])


def _weights(rows: DataFrame, fit, places: np.ndarray) -> dict[str, float]:
    """Weights by word: those words of the sample whose place has one, a few hundred as a rule."""
    weights = dict(zip(places[fit["at"]].tolist(), fit["weights"], strict=True))
    if not weights:
        return {}
    columns = F.broadcast(rows.sparkSession.createDataFrame([(int(i),) for i in weights], "place int"))
    each = rows.select(F.explode("words").alias("word")).distinct().withColumn("place", _place(F.col("word")))
    return {r["word"]: weights[r["place"]] for r in each.join(columns, "place").collect()}


def _place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(TERMS)).cast("int")


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], examples: int = EXAMPLES, folds: int = FOLDS
) -> Chain:
    """Chain over the 0/1 columns `categories` of `labels(doc_id, ...)`, in that order.

    Rows with a null label or doc_id are left out; of several labels of a document the
    larger counts, of several texts of a doc_id the one with the smallest hash. Where the labels
    leave nothing to learn, the model is their constant.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    categories = list(categories)
    judged = labels.select("doc_id", *[F.col(c).cast("double").alias(c) for c in categories]).na.drop()
    judged = judged.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    # the bound of this sample is what may be broadcast
    sample = judged.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(examples)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # one text a doc_id; the limit is applied before the shuffle, so a doc_id of many rows is no burden
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.length("text"))
    chosen = chosen.withColumn("_n", F.row_number().over(first)).where("_n = 1")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 256):  # lists of words are large
                part = batch.iloc[low : low + 256]
                found = [features(t) for t in part["text"]]
                out = part[["row", *categories]].assign(words=[sorted(w) for w, _, _ in found])
                yield out.assign(dense=[[a, b] for _, a, b in found])

    y = ", ".join(f"`{c}` double" for c in categories)
    numbered = chosen.withColumn("row", F.xxhash64("doc_id", F.xxhash64("text")))
    rows = scratch.write(
        numbered.select("row", "text", *categories).mapInPandas(extract, f"row long, {y}, words array<string>, dense array<double>")
    ).df
    if rows.isEmpty():
        return Chain(categories, [Linear({}, [0.0] * (2 + i), -1000.0) for i in range(len(categories))])
    placed = rows.withColumn("words", F.array_distinct(F.transform("words", _place)))
    counted = placed.select(F.explode("words").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    # TERMS numbers at most
    places = np.sort(counted.select("place").toPandas()["place"].to_numpy(np.int64))
    shared = spark.sparkContext.broadcast(places.astype(np.int32))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = np.full(TERMS, -1, np.int32)
        column[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            found = [column[np.asarray(w, np.int64)] for w in batch["words"]]
            yield batch.assign(words=[np.sort(w[w >= 0]) for w in found])

    state = scratch.write(placed.select("row", *categories, "words", "dense").mapInPandas(number, f"row long, {y}, words array<int>, dense array<double>")).df
    models = []
    for i, category in enumerate(categories):
        fits = _fit(state, category, len(places), folds if i + 1 < len(categories) else 0)
        models.append(Linear(_weights(rows, fits[-1], places), list(fits[-1]["dense"]), fits[-1]["intercept"]))
        if i + 1 < len(categories):
            state = scratch.write(_out_of_fold(state, fits, folds)).df
    return Chain(categories, models)


def _fold(folds: int):
    return F.pmod(F.xxhash64("row", F.lit(11)), F.lit(folds)).cast("int")


def _fit(rows: DataFrame, category: str, terms: int, folds: int) -> list:
    """Weights without each fold, and of all rows as the last: one task a fit, on bounded rows."""
    jobs = F.expr(f"filter(sequence(0, {folds}), j -> j <> fold)") if folds else F.array(F.lit(0))
    each = rows.withColumn("fold", _fold(folds) if folds else F.lit(-1)).select(
        F.explode(jobs).alias("job"), "row", "words", "dense", F.col(category).alias("y")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        y = pdf["y"].to_numpy(float)
        dense = np.array(pdf["dense"].tolist(), float)
        job = int(pdf["job"].iloc[0])
        if y.min() == y.max():
            constant = 1000.0 if y[0] else -1000.0
            return pd.DataFrame([(job, [], [], [0.0] * dense.shape[1], constant)], columns=["job", "at", "weights", "dense", "intercept"])
        at = np.concatenate([np.asarray(w, np.int64) for w in pdf["words"]])
        sizes = pdf["words"].map(len).to_numpy(np.int64)
        w, own, intercept = fit_linear(at, sizes, dense, y, terms, PENALTY, ROUNDS)
        kept = np.flatnonzero(w)
        row = (job, kept.tolist(), w[kept].tolist(), own.tolist(), intercept)
        return pd.DataFrame([row], columns=["job", "at", "weights", "dense", "intercept"])

    schema = "job int, at array<int>, weights array<double>, dense array<double>, intercept double"
    found = {r["job"]: r for r in each.groupBy("job").applyInPandas(fit, schema).collect()}
    # with very few rows a fold may hold all of them; its rows then take the model of all
    return [found.get(j, found[folds]) for j in range(folds + 1)]


def _out_of_fold(rows: DataFrame, fits: list, folds: int) -> DataFrame:
    """`rows` with the probability of the model without their fold behind the dense columns."""
    plain = [(dict(zip(f["at"], f["weights"], strict=True)), list(f["dense"]), f["intercept"]) for f in fits[:folds]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [Linear(*p) for p in plain]
        for batch in batches:
            p = [
                models[k].probability(set(map(int, w)), d)
                for k, w, d in zip(batch["fold"], batch["words"], batch["dense"], strict=True)
            ]
            out = batch.drop(columns="fold")
            yield out.assign(dense=[[*d, x] for d, x in zip(batch["dense"], p, strict=True)])

    return rows.withColumn("fold", _fold(folds)).mapInPandas(run, rows.schema)


def with_quality(labels: DataFrame) -> DataFrame:
    """`labels(doc_id, quality, toxic)` with the category `low_quality`, the opposite of quality."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ("low_quality", "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with p_low_quality, p_toxic and `is_toxic` (p_toxic >= threshold).

    Without labels every probability is 0. Null texts have no words. Repeated rows get
    equal scores; an empty table stays empty.
    """
    chain = fit_chain(docs, with_quality(labels), CATEGORIES)
    return chain.score(docs.drop("is_toxic")).withColumn("is_toxic", F.col("p_toxic") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows judged toxic."""
    return toxicity(docs, labels, threshold).where(~F.col("is_toxic")).select(*docs.columns)
