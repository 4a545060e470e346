"""The rows with the largest inner products, without comparing everything.

A product with an item is at most the product of the two lengths. Items are therefore
taken in blocks of falling length, each twice as large as the one before. A user keeps its
k best so far and leaves as soon as its own length times the largest length still to come is
below its k-th product. So most users see the long items only, and what is left out could not
have been in the answer.

A round broadcasts one piece of the items, of at most `PIECE` numbers, and writes the users that
go on. Users are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

#: Items of the first block.
FIRST = 1024
#: Numbers in a piece of the items that is broadcast: 16 MB.
PIECE = 1 << 21
#: The bound is compared with a margin for rounding.
SLACK = 1e-9


def _pieces(items: DataFrame, piece: int) -> list[tuple[int, int, int, float]]:
    """(block, piece, pieces, largest length), by falling length."""
    found = items.groupBy("block").agg(F.max("length").alias("top"), F.sum(F.size("x")).alias("numbers")).collect()
    out = []
    for r in sorted(found, key=lambda r: r["block"]):
        n = max(1, -(-r["numbers"] // piece))
        out += [(r["block"], i, n, r["top"]) for i in range(n)]
    return out


def _blocks(items: DataFrame, first: int, scratch: Scratch) -> DataFrame:
    """`items` with `length` and `block`, 0 for the longest."""
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e))
    plain = scratch.write(items.withColumn("length", length)).df
    total = plain.count()
    shares, size, seen = [], first, first
    while seen < total:
        shares.append(1 - seen / total)
        size, seen = 2 * size, seen + 2 * size
    if not shares:
        return plain.withColumn("block", F.lit(0))
    edges = plain.agg(F.percentile_approx("length", shares, 100_000)).first()[0]
    below = sum((F.col("length") <= e).cast("int") for e in edges)
    return plain.withColumn("block", below)


def largest_products(users: DataFrame, items: DataFrame, k: int, first: int = FIRST, piece: int = PIECE) -> DataFrame:
    """`(user, item, product)`: the `k` items of the largest inner product with each user.

    `users(id, x)` and `items(id, x)` hold arrays of one length; rows without one are left out. Of
    equal products the smaller item ids win. A user with fewer than `k` items gets all of them.
    """
    spark = users.sparkSession
    scratch = Scratch(spark, "products")
    users, items = (df.select("id", F.col("x").cast("array<double>").alias("x")).where("x is not null") for df in (users, items))
    kinds = dict(users.dtypes)["id"], dict(items.dtypes)["id"]
    blocked = scratch.write(_blocks(items, first, scratch)).df
    steps = _pieces(blocked, piece)
    schema = f"id {kinds[0]}, x array<double>, items array<{kinds[1]}>, products array<double>, open boolean"
    state = users.select("id", "x", F.array().cast(f"array<{kinds[1]}>").alias("items"), F.array().cast("array<double>").alias("products"))
    parts = []
    for i, (block, part, n, _) in enumerate(steps):
        chosen = blocked.where((F.col("block") == block) & (F.pmod(F.xxhash64("id"), F.lit(n)) == part)).orderBy("id")
        held = chosen.select("id", "x").toPandas()  # PIECE numbers at most, by the count above
        if not len(held):
            continue
        shared = spark.sparkContext.broadcast((held["id"].to_numpy(), np.stack(list(held["x"]))))
        still = steps[i + 1][3] if i + 1 < len(steps) else -1.0
        written = scratch.write(state.mapInPandas(_meet(shared, k, still), schema)).df
        parts.append(written.where("not open"))
        state = written.where("open").drop("open")
        if state.isEmpty():
            break
    if not parts:
        return spark.createDataFrame([], f"user {kinds[0]}, item {kinds[1]}, product double")
    done = parts[0]
    for other in parts[1:]:
        done = done.unionByName(other)
    return done.select(F.col("id").alias("user"), F.explode(F.arrays_zip("items", "products")).alias("r")).selectExpr("user", "r.items as item", "r.products as product")


def _meet(shared, k: int, still: float):
    """Rows of users with their best after one more piece; `open` if a longest item to come, of length `still`, could get in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = shared.value
        for pdf in batches:
            items, products, goes_on = [], [], []
            step = max(1, (1 << 22) // len(ids))
            for low in range(0, len(pdf), step):
                part = pdf.iloc[low : low + step]
                own = np.stack([np.asarray(v, float) for v in part["x"]])
                scores, lengths = own @ x.T, np.sqrt((own**2).sum(axis=1))
                for row, length, old, best in zip(scores, lengths, part["items"], part["products"], strict=True):
                    at = np.arange(len(row))
                    if len(row) > k:
                        at = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    all_ids, all_products = np.concatenate([np.asarray(old, ids.dtype), ids[at]]), np.concatenate([np.asarray(best, float), row[at]])
                    order = np.lexsort((all_ids, -all_products))[:k]
                    items.append(all_ids[order])
                    products.append(all_products[order])
                    goes_on.append(bool(still >= 0 and (len(order) < k or length * still * (1 + SLACK) >= all_products[order[-1]])))
            yield pdf[["id", "x"]].assign(items=items, products=products, open=goes_on)

    return run
