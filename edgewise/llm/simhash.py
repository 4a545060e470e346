"""SimHash near-duplicates with the generalised pigeonhole principle.

A fingerprint has 64 bits; two link if at most `radius` differ. The bits are cut
into m groups with thresholds t_i that add up to radius - m + 1 (t_i = -1 leaves a
group out): if every group differed in more than t_i bits, the sum would exceed
the radius, so each linked pair agrees within t_i in at least one group.
Correlated bits are put into one group, as they say little beyond each other, and
a dynamic program gives each group the threshold with the least estimated work.
Estimates use the bit counts of all fingerprints; they steer the work, never the result.

Within a group, a pair at distance t meets at a value that one side reaches by
ceil(t/2) flips and the other by floor(t/2); equal values are joined and pairs
verified on all 64 bits. A value that more than HOT fingerprints come to is not
joined: those fingerprints meet instead at all points within radius/2 of each, which
is exact for any even radius and linear in their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.operators.components import connected_components
from edgewise.plans.scratch import Scratch

WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one probed value above which the value is not joined pair by pair.
HOT = 1000
#: Cost of a probe key relative to that of a candidate pair.
KEY_COST = 4


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, lower-cased in A-Z; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED) if joined else 0
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    values = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 4096):
        part = np.array(values[at : at + 4096], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """`(doc_id, tie, fp)`; `tie` is the hash of the text, `fp` a signed long."""

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tie": batch["tie"], "fp": found})

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return keyed.mapInPandas(prints, "doc_id long, tie long, fp long")


def bit_counts(prints: DataFrame) -> np.ndarray:
    """64 x 64: in how many of all fingerprints two bits are both set. 2,080 sums reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += bits.T.astype(np.float64) @ bits.astype(np.float64)
        a, b = np.triu_indices(64)
        yield pd.DataFrame({"a": a, "b": b, "n": total[a, b].astype(np.int64)})

    out = np.zeros((64, 64))
    for row in prints.select("fp").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[row["a"], row["b"]] = out[row["b"], row["a"]] = row["n"]
    return out


def group_bits(counts: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Bits in `groups` parts of nearly equal size, the most correlated together."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.abs(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 1e-12))
    np.fill_diagonal(strength, 0)
    free, out = list(range(64)), []
    for g in range(groups):
        size = 64 // groups + (g < 64 % groups)
        part = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (strength[b, part].sum(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def expected_pairs(differ: np.ndarray, n: int, most: int) -> np.ndarray:
    """Pairs at distance 0..`most` or less, for bits that differ with these probabilities."""
    mass = np.zeros(most + 2)
    mass[0] = 1.0
    for q in differ:
        mass[1:] = mass[1:] * (1 - q) + mass[:-1] * q
        mass[0] *= 1 - q
    return np.cumsum(mass[: most + 1]) * (n * (n - 1) / 2)


def reach(width: int, flips: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(flips + 1))


def plan(counts: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Bit groups with their thresholds, for the number of groups with the least estimated work."""
    p = np.diag(counts) / max(n, 1)
    best = None
    for m in range(2, radius + 2):
        parts = group_bits(counts, n, m)
        cost = []
        for part in parts:
            pairs = expected_pairs(2 * p[part] * (1 - p[part]), n, radius)
            keys = [reach(len(part), (t + 1) // 2) + reach(len(part), t // 2) for t in range(radius + 1)]
            cost.append([0.0] + [pairs[t] + KEY_COST * n * keys[t] for t in range(radius + 1)])
        # state: sum of (threshold + 1) so far; all of them must add up to radius + 1
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, chosen) in table.items():
                for t in range(-1, radius - used + 1):
                    offer = (spent + row[t + 1], [*chosen, t])
                    if used + t + 1 not in step or offer < step[used + t + 1]:
                        step[used + t + 1] = offer
            table = step
        spent, chosen = table[radius + 1]
        if best is None or spent < best[0]:
            best = (spent, [(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _variants(part: list[int], flips: int) -> Column:
    """Values of a group's bits reached by up to `flips` flips."""
    masks = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(part, k)]
    value = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))
    listed = F.array(*[F.lit(_signed(m)) for m in masks])
    return F.transform(listed, lambda m: value.bitwiseXOR(m))


def _keys(prints: DataFrame, groups: list[tuple[list[int], int]], up: bool) -> DataFrame:
    """`(part, key, fp)`: the probed values, by the longer reach (`up`) or the shorter one."""
    lists = F.array(
        *[
            F.struct(F.lit(i).alias("part"), _variants(part, (t + up) // 2).alias("keys"))
            for i, (part, t) in enumerate(groups)
        ]
    )
    return prints.select("fp", F.inline(lists)).select("part", "fp", F.explode("keys").alias("key"))


def links(prints: DataFrame, groups: list[tuple[list[int], int]], radius: int, hot: int, scratch: Scratch) -> DataFrame:
    """Edges `(src, dst)` whose components are those of all pairs within `radius`, 1 to 4; `prints` are distinct."""
    if not 1 <= radius <= 4:
        raise ValueError("links are found for a radius from 1 to 4")
    left, right = _keys(prints, groups, True), _keys(prints, groups, False)
    crowded = scratch.write(
        right.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("part", "key")
    ).df
    none = crowded.isEmpty()
    if not none:
        touching = scratch.write(left.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()).df
        left, right = (x.join(crowded, ["part", "key"], "left_anti") for x in (left, right))
    other = right.select("part", "key", F.col("fp").alias("dst"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("dst"))) <= radius
    # either order of a pair meets, so one is enough
    # keys are many more than the planner can tell from the files, so neither side is for broadcast
    found = left.hint("merge").join(other.hint("merge"), ["part", "key"]).where((F.col("fp") < F.col("dst")) & near)
    edges = found.select(F.col("fp").alias("src"), "dst").distinct()
    if none:
        return edges
    # fingerprints within the radius share a point that is half of it from one and the rest from the other;
    # all that reach a point by the longer way link to the smallest that does by the shorter one.
    # Points are many more than the planner can tell as well.
    low = _points(touching, radius // 2).groupBy("p").agg(F.min("fp").alias("src"))
    members = _points(touching, (radius + 1) // 2)
    return edges.unionByName(
        members.hint("merge").join(low.hint("merge"), "p").where("fp <> src").select("src", F.col("fp").alias("dst")).distinct()
    )


def _points(prints: DataFrame, flips: int) -> DataFrame:
    """`(fp, p)`: every value within `flips` (0, 1 or 2) flipped bits of each fingerprint; place 64 flips nothing."""
    bit = "if({0} = 64, 0L, shiftleft(1L, {0}))"
    if not flips:
        return prints.select("fp", F.col("fp").alias("p"))
    points = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", F.expr(f"fp ^ {bit.format('i')}").alias("p"), "i")
    if flips == 1:
        return points.select("fp", "p")
    second = F.expr("explode(if(i >= 63, array(64), sequence(i + 1, 64)))").alias("j")
    return points.select("fp", "p", "i", second).select("fp", F.expr(f"p ^ {bit.format('j')}").alias("p"))


def _grouped(docs: DataFrame, radius: int, hot: int, scratch: Scratch) -> DataFrame:
    """`(doc_id, tie, fp, label, component_id)`; `label` is the smallest fingerprint that links lead to."""
    rows = scratch.write(fingerprints(docs)).df
    distinct = scratch.write(
        rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    ).df
    n = distinct.count()
    groups = plan(bit_counts(distinct), n, radius)
    edges = scratch.write(links(distinct.select("fp"), groups, radius, hot, scratch)).df
    found = connected_components(edges)
    labels = found.labels.select(F.col("node").alias("fp"), "component")
    linked = distinct.join(labels, "fp").select("fp", "low", "component")
    lows = linked.groupBy("component").agg(F.min("low").alias("least"))
    moved = linked.join(lows, "component").select("fp", "component", "least")
    # fingerprints of one document that link to nothing need no look-up
    named = distinct.join(moved, "fp", "left").where("n > 1 or component is not null")
    named = scratch.write(named.select("fp", "component", F.coalesce("least", "low").alias("component_id"))).df
    return rows.join(named, "fp", "left").select(
        "doc_id",
        "tie",
        "fp",
        F.coalesce("component", "fp").alias("label"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, tie, fp, fingerprint, component_id.

    The component is the smallest doc_id that links lead to. Null and empty texts
    have the fingerprint zero and link like any other; equal texts have equal
    fingerprints; repeated rows get a row each; an empty table gives none. A null
    doc_id never names a component that has another id, so null or repeated ids can
    stand for several components. Other columns are not read.
    """
    return _grouped(docs, radius, hot, Scratch(docs.sparkSession, "simhash")).select(
        "doc_id",
        "tie",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest doc_id.

    A group is a set of linked fingerprints, whatever its ids: texts that do not link
    all stay, under null or equal ids as well. Null ids come last; of rows with the
    smallest doc_id the one with the smallest text hash stays, of fully equal ones
    any. All columns are kept.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    rows = scratch.write(_grouped(docs, radius, hot, scratch).select("doc_id", "tie", "label")).df
    counted = rows.groupBy("label", "doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    # false sorts before true, so a null doc_id is taken only where there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "n")).alias("first")
    chosen = scratch.write(
        counted.groupBy("label").agg(first).select(
            F.col("first.doc_id").alias("_ew_id"), F.col("first.tie").alias("_ew_tie"), F.col("first.n").alias("_ew_n")
        )
    ).df
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_ew_id"]) & (F.xxhash64(docs["text"]) == F.col("_ew_tie")))
    single = kept.where("_ew_n = 1").select(*docs.columns)
    if chosen.where("_ew_n > 1").isEmpty():
        return single
    several = kept.where("_ew_n > 1").dropDuplicates(["_ew_id", "_ew_tie"]).select(*docs.columns)
    return single.unionByName(several)
