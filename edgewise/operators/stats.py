"""Statistics as aggregates: tests, metrics, densities, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch
from edgewise.plans.skew import join_counted


def goodness_of_fit(counts: DataFrame, observed: str, expected: str | None = None) -> DataFrame:
    """Chi-square statistic of observed counts, against equal counts by default."""
    total = counts.agg(F.sum(observed).alias("total"), F.count(F.lit(1)).alias("k")).first()
    want = F.col(expected) if expected else F.lit(total["total"] / total["k"])
    part = F.pow(F.col(observed) - want, 2) / want
    return counts.agg(F.sum(part).alias("statistic"), F.lit(total["k"] - 1).alias("df"))


def chi_square_tail(x: float, df: int) -> float:
    """Probability of a chi-square value of `x` or more, `df` degrees of freedom: the finite sums for whole ones."""
    if x <= 0 or df <= 0:
        return 1.0
    half = x / 2
    # from the exponential (even) or the normal tail (odd)
    k, total = (1.0, math.exp(-half)) if df % 2 == 0 else (0.5, math.erfc(math.sqrt(half)))
    while k < df / 2:
        total += math.exp(k * math.log(half) - half - math.lgamma(k + 1))
        k += 1
    return min(1.0, total)


def with_p_value(tests: DataFrame) -> DataFrame:
    """`tests(statistic, df)`, a row per test, with `p_value`."""
    tail = F.udf(lambda x, df: None if x is None or df is None else chi_square_tail(x, int(df)), "double", useArrow=True)
    return tests.withColumn("p_value", tail(F.col("statistic").cast("double"), "df"))


def independence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic of two categorical columns, from their contingency table.

    sum((o - e)^2 / e) is n * (sum(o^2 / (row * column)) - 1), so cells that are
    empty need not exist as rows.
    """
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    left = cells.groupBy(a).agg(F.sum("o").alias("in_a"))
    right = cells.groupBy(b).agg(F.sum("o").alias("in_b"))
    share = F.col("o") * F.col("o") / (F.col("in_a") * F.col("in_b"))
    return (
        cells.join(left, a)
        .join(right, b)
        .agg(
            (F.sum("o") * (F.sum(share) - 1)).alias("statistic"),
            ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"),
        )
    )


def average_ranks(rows: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """`(column, n, rank)` per distinct value: rows that have it, and their mean rank from 1.

    Values are counted, sorted into ranges and numbered range by range, so neither the
    ties of a value nor all values meet in one task. Nulls have no rank.
    """
    counted = rows.select(column).na.drop().groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(parts, column).withColumn("_part", F.spark_partition_id())
    values = scratch.write(ranged).df
    # one row per range
    before, at = [], 0
    for row in sorted(values.groupBy("_part").agg(F.sum("n").alias("n")).collect()):
        before.append((row["_part"], at))
        at += row["n"]
    shift = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n").over(inside), F.lit(0))
    numbered = values.withColumn("_within", within).join(F.broadcast(shift), "_part")
    return numbered.select(column, "n", (F.col("_before") + F.col("_within") + (F.col("n") + 1) / 2).alias("rank"))


def running_by_score(counts: DataFrame, score: str, sums: Sequence[str], scratch: Scratch) -> DataFrame:
    """`counts` (one row a score) with `<sum>_before`: the sums over all rows of higher score.

    Rows are sorted into ranges of the score; a task adds up its range, and one row per range
    tells the others what lies above them.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, F.desc(score)).withColumn("_part", F.spark_partition_id())
    values = scratch.write(ranged).df
    before, at = [], [0.0] * len(sums)
    for row in sorted(values.groupBy("_part").agg(*[F.sum(c).cast("double").alias(c) for c in sums]).collect()):
        before.append((row["_part"], *at))
        at = [x + row[c] for x, c in zip(at, sums, strict=True)]
    shift = counts.sparkSession.createDataFrame(before, "_part int, " + ", ".join(f"`_{c}` double" for c in sums))
    inside = Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    out = values.join(F.broadcast(shift), "_part")
    for c in sums:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside).cast("double"), F.lit(0.0)) + F.col(f"_{c}"))
    return out.drop("_part", *[f"_{c}" for c in sums])


def threshold_curve(rows: DataFrame, score: str, label: str, scratch: Scratch) -> DataFrame:
    """`(score, tp, fp, tp_before, fp_before)`: hits and false alarms at and above each distinct score, and above it.

    `label` is boolean; rows without a score or label are left out. Equal scores are one point.
    """
    known = rows.select(F.col(score).cast("double").alias("score"), F.col(label).alias("_y")).na.drop().where(~F.isnan("score"))
    counts = known.groupBy("score").agg(F.count_if("_y").alias("p"), F.count_if(~F.col("_y")).alias("n"))
    curve = running_by_score(counts, "score", ["p", "n"], scratch)
    return curve.select(
        "score", (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp"), F.col("p_before").alias("tp_before"), F.col("n_before").alias("fp_before")
    )


def curve_areas(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Areas under the ROC and the precision-recall curve, by trapezoids, in one row.

    Every point knows the one before it, over range borders too. The precision-recall curve
    starts at recall 0 with the precision of its first point. An area without both
    classes (ROC) or without positives (PR) is null.
    """
    curve = threshold_curve(rows, score, label, Scratch(rows.sparkSession, "curve"))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    above = F.col("tp_before") + F.col("fp_before")
    earlier = F.when(above > 0, F.col("tp_before") / above).otherwise(precision)
    step = F.col("tp") - F.col("tp_before")
    totals = curve.agg(
        F.sum((F.col("fp") - F.col("fp_before")) * (F.col("tp") + F.col("tp_before")) / 2).alias("roc"),
        F.sum(step * (precision + earlier) / 2).alias("pr"),
        F.max("tp").alias("p"),
        F.max("fp").alias("n"),
    )
    return totals.selectExpr("roc / nullif(p * n, 0) as area_roc", "pr / nullif(p, 0) as area_pr")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation of two columns, in one row; pairs with a null are left out."""
    scratch = Scratch(rows.sparkSession, "spearman")
    pairs = scratch.write(rows.select(F.col(a).alias("a"), F.col(b).alias("b")).na.drop()).df
    total = pairs.count()
    for side in ("a", "b"):
        ranks = average_ranks(pairs.select(side), side, scratch).withColumnRenamed("rank", f"r_{side}")
        pairs = join_counted(pairs, ranks, [side], "n", total)
    return pairs.agg(F.corr("r_a", "r_b").alias("spearman"))


def kernel_density(rows: DataFrame, value: str, points: Sequence[float], bandwidth: float):
    """Gaussian kernel density at a few points, in one pass over the rows."""
    scale = 1 / (bandwidth * math.sqrt(2 * math.pi))
    at = [
        F.struct(
            F.lit(float(p)).alias("point"),
            (F.avg(F.exp(-F.pow((F.col(value) - p) / bandwidth, 2) / 2)) * scale).alias("density"),
        )
        for p in points
    ]
    return rows.agg(F.array(*at).alias("all")).select(F.inline("all"))


def share(key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def sample_strata(
    rows: DataFrame, stratum: str, fractions: dict[str, float], key: Sequence[str], seed: int = 0
) -> DataFrame:
    """Fraction of each stratum, the same rows in every run."""
    limit = F.lit(0.0)
    for name, fraction in fractions.items():
        limit = F.when(F.col(stratum) == name, F.lit(fraction)).otherwise(limit)
    return rows.where(share(key, seed) < limit)


def sample_fixed(rows: DataFrame, k: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """A sample of exactly `k` rows: those with the smallest hash."""
    ordered = rows.withColumn("_share", share(key, seed)).orderBy("_share", *key).limit(k)
    return ordered.drop("_share")


def sample_exact(
    rows: DataFrame, stratum: str, fractions: dict[str, float], key: Sequence[str], seed: int = 0
) -> DataFrame:
    """Exactly ceil(fraction * size) rows of each stratum: those with the smallest hashes, the same in every run.

    A row below the lower of two thresholds is in, one above the higher is out; the thresholds
    lie so close around the wanted size that only a short waiting list between them is
    ordered. Should they miss, they are moved apart. Strata without a fraction give no row;
    `key` must tell rows apart.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "strata")
    kind = dict(rows.dtypes)[stratum]
    listed = spark.createDataFrame([(k, float(v)) for k, v in fractions.items() if v > 0], f"`{stratum}` {kind}, _fraction double")
    drawn = rows.join(F.broadcast(listed), stratum).withColumn("_share", share(key, seed))
    width = 5.0
    while True:
        # the number below a threshold t is n * t, give or take `width` deviations
        sizes = rows.join(F.broadcast(listed), stratum).groupBy(stratum, "_fraction").agg(F.count(F.lit(1)).alias("n"))
        want = F.ceil(F.round(F.col("_fraction") * F.col("n"), 9))
        spread = F.lit(width) * F.sqrt(F.greatest(F.col("_fraction") * F.col("n"), F.lit(1.0))) / F.col("n")
        limits = sizes.select(stratum, want.alias("_want"), (want / F.col("n") - spread).alias("_low"), (want / F.col("n") + spread).alias("_high"))
        marked = drawn.join(F.broadcast(limits), stratum)
        below = marked.groupBy(stratum).agg(
            F.first("_want").alias("_want"), F.count_if(F.col("_share") < F.col("_low")).alias("_in"), F.count_if(F.col("_share") < F.col("_high")).alias("_near")
        )
        counted = scratch.write(below).df  # a row a stratum
        if counted.where("_in > _want or _near < _want").isEmpty():
            break
        width *= 4
    taken = marked.where(F.col("_share") < F.col("_low"))
    order = Window.partitionBy(stratum).orderBy("_share", *key)
    waiting = marked.where((F.col("_share") >= F.col("_low")) & (F.col("_share") < F.col("_high"))).withColumn("_r", F.row_number().over(order))
    more = waiting.join(F.broadcast(counted.select(stratum, (F.col("_want") - F.col("_in")).alias("_more"))), stratum).where(F.col("_r") <= F.col("_more"))
    return taken.select(*rows.columns).unionByName(more.select(*rows.columns))


def sample_with_replacement(rows: DataFrame, rate: float, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Each row a Poisson number of times, `rate` on average, with `copy` from 1; the same in every run.

    The number is read off the distribution at the row's hash, so a rerun of a task draws the
    same, and no row waits for another.
    """
    levels, term, total = [], math.exp(-rate), 0.0
    while total + term < 1 - 2.0**-33 and len(levels) < 1000:
        total += term
        levels.append(total)
        term *= rate / len(levels)
    times = F.size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda level: level <= F.col("_share")))
    drawn = rows.withColumn("_share", share(key, seed)).withColumn("_n", times).where("_n > 0")
    return drawn.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def binary_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of two boolean columns."""
    y, p = F.col(label), F.col(predicted)
    counts = rows.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )
    return counts.selectExpr(
        "(tp + tn) / (tp + fp + fn + tn) as accuracy",
        "tp / (tp + fp) as precision",
        "tp / (tp + fn) as recall",
        "2 * tp / (2 * tp + fp + fn) as f1",
    )


def multiclass_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: rows, hits, precision, recall, F1; from the confusion counts.

    A class that is never predicted has precision 0. Classes with a null in either
    column are left out.
    """
    cells = confusion(rows, label, predicted)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("own"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("own"), F.col("n").alias("said")),
    )
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    # the hit counts once: on the label's side
    per = cells.select(hit.alias("hit"), F.posexplode(sides).alias("side", "s")).select(
        "s.c", "s.own", "s.said", F.when(F.col("side") == 0, F.col("hit")).otherwise(0).alias("hit")
    )
    sums = per.groupBy(F.col("c").alias("label")).agg(
        F.sum("own").alias("n"), F.sum("said").alias("said"), F.sum("hit").alias("hits")
    )
    return sums.selectExpr(
        "label",
        "n",
        "hits",
        "if(said > 0, hits / said, 0.0D) as precision",
        "if(n > 0, hits / n, 0.0D) as recall",
        "if(n + said > 0, 2 * hits / (n + said), 0.0D) as f1",
    )


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Rows per pair of classes `(label, predicted, n)`."""
    both = rows.select(F.col(label).alias("label"), F.col(predicted).alias("predicted")).na.drop()
    return both.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(classes: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 weighted by the rows of each class."""
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    return classes.agg((F.sum("hits") / F.sum("n")).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def regression_metrics(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    error = F.col(predicted) - F.col(label)
    return rows.agg(
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / (F.var_pop(label) * F.count(label))).alias("r2"),
    )


def multilabel_metrics(rows: DataFrame, label: str, predicted: str, n_labels: int | None = None) -> DataFrame:
    """Figures of two array columns without repeats, in one row.

    Per example: accuracy, precision, recall, F1, share of equal sets. Over all entries (micro):
    precision, recall, F1. Hamming loss is the share of the `n_labels` labels (by default those that
    occur in `label`) that are wrong. An empty set counts as right where the other is empty too.
    """
    if n_labels is None:
        n_labels = rows.select(F.explode(label)).distinct().count()
    hits, said, own = F.size(F.array_intersect(label, predicted)), F.size(predicted), F.size(label)

    def share_of(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.when(own + said == 0, 1.0).otherwise(0.0))

    return rows.select(hits.alias("h"), said.alias("s"), own.alias("o"), share_of(hits, own + said - hits).alias("a"), share_of(hits, said).alias("p"), share_of(hits, own).alias("r"), share_of(2 * hits, own + said).alias("f")).agg(
        F.avg("a").alias("accuracy"),
        F.avg("p").alias("precision"),
        F.avg("r").alias("recall"),
        F.avg("f").alias("f1"),
        F.avg(((F.col("h") == F.col("s")) & (F.col("h") == F.col("o"))).cast("double")).alias("equal_sets"),
        (F.sum(F.col("o") + F.col("s") - 2 * F.col("h")) / (F.count(F.lit(1)) * n_labels)).alias("hamming_loss"),
        (F.sum("h") / F.sum("s")).alias("micro_precision"),
        (F.sum("h") / F.sum("o")).alias("micro_recall"),
        (2 * F.sum("h") / (F.sum("s") + F.sum("o"))).alias("micro_f1"),
    )


def multilabel_by_label(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """`(label, precision, recall, f1)`: each label counted over all rows."""

    def side(k: int, own: str, other: str) -> Column:
        return F.transform(own, lambda x: F.struct(x.alias("label"), F.array_contains(other, x).alias("hit"), F.lit(k).alias("side")))

    sides = F.array(side(0, label, predicted), side(1, predicted, label))
    each = rows.select(F.explode(F.flatten(sides)).alias("x"))
    sums = each.groupBy("x.label").agg(F.count_if(F.col("x.side") == 0).alias("own"), F.count_if(F.col("x.side") == 1).alias("said"), F.count_if(F.col("x.hit") & (F.col("x.side") == 0)).alias("hits"))
    return sums.selectExpr("label", "coalesce(hits / nullif(said, 0), 0.0D) as precision", "coalesce(hits / nullif(own, 0), 0.0D) as recall", "2 * hits / (own + said) as f1")


def ranking_metrics(rows: DataFrame, predicted: str, relevant: str, k: int) -> DataFrame:
    """Precision, recall and NDCG at `k`, and mean average precision.

    Both columns are arrays, the prediction in rank order without repeats.
    """
    top = F.slice(predicted, 1, k)
    hits = F.size(F.array_intersect(top, relevant))
    gain = lambda i: 1 / F.log2(i + 2)
    add = lambda total, x: total + x
    zero = F.lit(0.0)
    dcg = F.aggregate(
        F.transform(top, lambda x, i: F.when(F.array_contains(relevant, x), gain(i)).otherwise(0.0)),
        zero,
        add,
    )
    best = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.least(F.size(relevant), F.lit(k)) - 1), gain), zero, add
    )
    precision_at = F.transform(
        predicted,
        lambda x, i: F.when(
            F.array_contains(relevant, x),
            F.size(F.array_intersect(F.slice(predicted, 1, i + 1), relevant)) / (i + 1),
        ).otherwise(0.0),
    )
    some = F.size(relevant) > 0
    per_row = rows.select(
        (hits / k).alias("_p"),
        F.when(some, hits / F.size(relevant)).otherwise(0.0).alias("_r"),
        F.when(some, dcg / best).otherwise(0.0).alias("_g"),
        F.when(some, F.aggregate(precision_at, zero, add) / F.size(relevant)).otherwise(0.0).alias("_a"),
    )
    return per_row.agg(
        F.avg("_p").alias("precision"),
        F.avg("_r").alias("recall"),
        F.avg("_g").alias("ndcg"),
        F.avg("_a").alias("map"),
    )
