"""Quality classifier: support vectors on naive Bayes features.

A text is the set of its n-grams: words, pairs of words, and one to three
consecutive word shapes (case, digits, the marks themselves, "again" for a word that
stood just before). N-grams are hashed into 2^BITS places, so no vocabulary is
cut off and a model has one size.

The indicator of a place is scaled by its class log-count ratio, the naive Bayes
evidence r = log (share of class 1) - log (share of class 0) with add-one counts, and
the rows are brought to length one. On them a linear model with hinge loss is
fitted by dual coordinate descent: one variable a row, each step solves its own
in closed form.

Margins become probabilities by a logistic curve through the margins of models that
did not see the row (out of fold). The fits run side by side on `EXAMPLES` labelled
rows at most, those with the smallest hashes of their doc_id. Scoring covers every row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.llm.base import worker_cache
from edgewise.plans.scratch import Scratch

EXAMPLES = 10_000
FOLDS = 3
BITS = 20
#: Weight of the hinge loss against the length of the weights.
COST = 1.0
EPOCHS = 30
THRESHOLD = 0.3
#: Bytes of token names a worker remembers between batches.
HELD_BYTES = 16 << 20

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
AGAIN = 7
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Tokens(dict):
    """Hash and shape of each token, worked out when first met."""

    held = 0

    def __missing__(self, token: str) -> tuple[int, int]:
        import xxhash

        own = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        if token.isalpha():
            shape = 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
        else:
            shape = 5 if token.isdigit() else own | 8
        if self.held > HELD_BYTES:
            self.clear()
            self.held = 0
        self.held += 120 + 2 * len(token)
        self[token] = own, shape
        return own, shape


def places(text: str | None, tokens: Tokens, bits: int = BITS) -> np.ndarray:
    """Sorted distinct places of the n-grams of a text."""
    found = TOKEN.findall(text) if isinstance(text, str) else []
    if not found:
        return np.empty(0, np.int64)
    pairs = np.fromiter((x for t in found for x in tokens[t]), np.uint64, 2 * len(found)).reshape(-1, 2)
    word, shape = pairs[:, 0], pairs[:, 1].copy()
    # of the two tokens before, as a mark may stand between two words
    again = np.zeros(len(word), bool)
    again[1:] |= word[1:] == word[:-1]
    again[2:] |= word[2:] == word[:-2]
    shape[again] = shape[again] * np.uint64(31) + np.uint64(AGAIN)
    two = shape[:-1] * STEP + shape[1:]
    grams = [
        _mixed(word + np.uint64(1)),
        _mixed(word[:-1] * STEP + word[1:] + np.uint64(2)),
        _mixed(shape * STEP + np.uint64(3)),
        _mixed(two * STEP + np.uint64(4)),
        _mixed((two[:-1] * STEP + shape[2:]) * STEP + np.uint64(5)),
    ]
    return np.unique((np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64))


def log_ratios(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Log of each place's share of all indicators of class 1, less that of class 0, with add-one counts."""
    one = np.repeat(y > 0, sizes)
    p, q = np.bincount(at[one], minlength=width) + 1.0, np.bincount(at[~one], minlength=width) + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_dual(at: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, cost: float = COST, epochs: int = EPOCHS, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) of the least |w|^2 / 2 + cost * sum of hinge losses.

    Row i has the values `x` at the places `at` from `sum(sizes[:i])` on, and a one for the
    bias. `y` is 1 or -1. Dual coordinate descent: rows in random order, each row's
    variable set to the best value in [0, cost], until no gradient is off by more.
    """
    w, alpha = np.zeros(width + 1), np.zeros(len(y))
    ends = np.cumsum(sizes)
    rows = [(at[e - n : e], x[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    curve = np.array([v @ v for _, v in rows]) + 1.0
    draw = np.random.default_rng(1)
    for _ in range(epochs):
        worst = 0.0
        for i in draw.permutation(len(y)):
            p, v = rows[i]
            slope = y[i] * (w[p] @ v + w[-1]) - 1
            off = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == cost else slope
            if off:
                worst = max(worst, abs(off))
                new = min(max(alpha[i] - slope / curve[i], 0.0), cost)
                move, alpha[i] = (new - alpha[i]) * y[i], new
                w[p] += move * v
                w[-1] += move
        if worst < tolerance:
            break
    return w


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of `y` (0, 1) over `margins`; targets a little inside (0, 1)."""
    ones, zeros = (y > 0).sum(), (y == 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 0.0, math.log((ones + 1) / (zeros + 1))

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float(np.logaddexp(0, z).sum() - (t * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        slope = np.array([((p - t) * margins).sum(), (p - t).sum()])
        c = p * (1 - p)
        bend = np.array([[(c * margins**2).sum(), (c * margins).sum()], [(c * margins).sum(), c.sum()]]) + 1e-9 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        step, now = 1.0, loss(a, b)
        while step > 1e-6 and loss(a - step * move[0], b - step * move[1]) > now:
            step /= 2
        a, b = a - step * move[0], b - step * move[1]
        if np.abs(step * move).max() < 1e-7:
            break
    # a curve that falls would turn the classes round; without evidence the score is the share of class 1
    return (float(a), float(b)) if a > 0 else (0.0, math.log((ones + 1) / (zeros + 1)))


@dataclass
class Model:
    """Per place weight times ratio and squared ratio; bias; logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    bits: int = BITS

    def margin(self, at: np.ndarray) -> float:
        length = math.sqrt(self.squares[at].sum(dtype=float)) if len(at) else 0.0
        return self.bias + (float(self.weights[at].sum(dtype=float)) / length if length else 0.0)

    def score(self, at: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.margin(at) + self.offset))))


def fit_model(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, bits: int = BITS) -> Model:
    """Ratios and weights on rows of places; `y` is 0 or 1."""
    width = 1 << bits
    r = log_ratios(at, sizes, y, width)
    filled = np.flatnonzero(sizes)
    length = np.zeros(len(sizes))
    if len(filled):
        length[filled] = np.sqrt(np.add.reduceat(r[at] ** 2, (np.cumsum(sizes) - sizes)[filled]))
    length[length == 0] = 1.0
    w = fit_dual(at, sizes, r[at] / np.repeat(length, sizes), np.where(y > 0, 1.0, -1.0), width)
    return Model(w[:-1] * r, r * r, float(w[-1]), bits=bits)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether a row's label is kept from the fit; a null doc_id is hashed as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)) == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, examples: int) -> DataFrame:
    """`(row, y, at)` of at most `examples` labelled rows: places of their n-grams.

    Left out are null labels and ids and held-out rows. Of several labels of a doc_id the larger
    counts, of several texts the one with the smallest hash.
    """
    judged = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    judged = judged.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    # the bound of this sample is what may be broadcast
    sample = judged.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(examples)
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).join(F.broadcast(sample), "doc_id")
    # one text a doc_id; the limit is applied before the shuffle, so a doc_id of many rows is no burden
    first = Window.partitionBy("doc_id").orderBy("tie", F.length("text"))
    chosen = chosen.withColumn("n", F.row_number().over(first)).where("n = 1")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            yield batch[["row", "y"]].assign(at=[places(t, tokens).astype(np.int32) for t in batch["text"]])

    return chosen.select(F.xxhash64("doc_id").alias("row"), "y", "text").mapInPandas(extract, "row long, y int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES, folds: int = FOLDS) -> Model:
    """Model of the labelled rows; without two classes its score is the share of class 1."""
    rows = Scratch(docs.sparkSession, "quality").write(labelled(docs, labels, label, examples)).df
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = math.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1))
    nothing = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, share)
    if len(seen) < 2:
        return nothing
    fold = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(folds)).cast("int")
    jobs = rows.withColumn("fold", fold).select(F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("job"), "fold", "row", "y", "at")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # job j fits without fold j and tells the margins of that fold; the last fits on all rows
        job = int(pdf["job"].iloc[0])
        pdf = pdf.sort_values("row", kind="stable")
        used = pdf[pdf["fold"] != job]
        out = {"job": job, "margins": [], "y": [], "weights": b"", "squares": b"", "bias": None}
        if used["y"].nunique() == 2:
            at = np.concatenate([np.asarray(x, np.int64) for x in used["at"]])
            model = fit_model(at, used["at"].map(len).to_numpy(np.int64), used["y"].to_numpy())
            rest = pdf[pdf["fold"] == job]
            out |= {"margins": [model.margin(np.asarray(x, np.int64)) for x in rest["at"]], "y": rest["y"].tolist(), "bias": model.bias}
            if job == folds:
                out |= {"weights": model.weights.astype("<f4").tobytes(), "squares": model.squares.astype("<f4").tobytes()}
        return pd.DataFrame([out])

    schema = "job int, margins array<double>, y array<int>, weights binary, squares binary, bias double"
    found = {r["job"]: r for r in jobs.groupBy("job").applyInPandas(run, schema).collect()}
    whole = found[folds]
    model = Model(np.frombuffer(whole["weights"], "<f4"), np.frombuffer(whole["squares"], "<f4"), whole["bias"])
    margins = np.array([m for j in range(folds) if j in found for m in found[j]["margins"]])
    y = np.array([v for j in range(folds) if j in found for v in found[j]["y"]])
    if len(set(y.tolist())) < 2:
        return model  # too few rows for folds: the margin itself
    model.slope, model.offset = fit_curve(margins, y)
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """`docs` with the probability of class 1; null and empty texts are scored by the bias alone."""
    # the size of a model is fixed: 2^BITS places
    packed = docs.sparkSession.sparkContext.broadcast((model.weights, model.squares, model.bias, model.slope, model.offset, model.bits))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, tokens = Model(*packed.value), worker_cache("quality").setdefault("tokens", Tokens())
        for texts in batches:
            yield pd.Series([model.score(places(t, tokens, model.bits)) for t in texts], dtype=float)

    return docs.withColumn(out, F.pandas_udf(run, "double")("text"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` (1 if score >= threshold); columns of these names are replaced.

    The score depends on the text alone, so equal texts have equal scores. Without labels of
    both classes it is one constant. An empty table stays empty.
    """
    kept = docs.drop("held_out", "score", "predicted")
    scored = score(kept.withColumn("held_out", held_out(F.col("doc_id"))), fit(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
