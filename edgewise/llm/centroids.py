"""Centroid clustering of integer vectors with a PCA-rotated filter.

Vectors are integers, and so are centroids (componentwise floors of means), so
distances, ties and sums are exact and a run is the same on any cluster.

The leading principal axes of all vectors are found once, from sums that Spark
adds up. Each vector is stored with its coordinates along them and the norm of
what is left (its residual). For a centroid rotated the same way

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2

by the triangle inequality in the space of the other axes. A round compares the
few stored numbers with all centroids. The centroid of the least bound is verified in
integers; of the others only those whose bound, less a margin for rounding, does
not exceed that distance. So the filter decides how much is computed, never the result.

A round sends one row of sums per task and centroid to the next step; k rows reach
the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgewise.plans.scratch import Scratch

#: Leading axes that are stored.
AXES = 8
#: Beyond this, squared distances of 64 components may leave the range of a long.
LARGEST = 1 << 27


def integers(vectors: DataFrame, size: int, scale: int, column: str = "embedding") -> DataFrame:
    """`(vec_id, v)` of the vectors with exactly `size` finite components, as floor(scale * x)."""
    x = F.col(column).cast("array<double>")
    # size() of null is -1 or null by setting; both fail the test
    whole = (F.size(x) == size) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    return kept.select("vec_id", F.transform(x, lambda e: F.floor(e * float(scale))).alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


@dataclass
class Rotation:
    """Mean and leading axes (columns) of all vectors."""

    mean: np.ndarray
    axes: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norms."""
        centred = x - self.mean
        lead = centred @ self.axes
        rest = (centred**2).sum(axis=1) - (lead**2).sum(axis=1)
        return lead, np.sqrt(np.maximum(rest, 0.0))


def rotation(vectors: DataFrame, size: int, axes: int) -> Rotation:
    """Principal axes of `vectors(v)`, from sums of products over blocks of rows."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, products, n = np.zeros(size), np.zeros((size, size)), 0
        for batch in batches:
            x = _matrix(batch.column("v")).astype(float)
            total, products, n = total + x.sum(axis=0), products + x.T @ x, n + len(x)
        sums = [n, *total.tolist(), *products.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["at", "value"])

    sums = vectors.select("v").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    found = np.zeros(1 + size + size * size)
    for r in sums.collect():
        found[r["at"]] = r["value"]
    n = max(found[0], 1.0)
    mean = found[1 : 1 + size] / n
    spread = found[1 + size :].reshape(size, size) / n - np.outer(mean, mean)
    return Rotation(mean, np.linalg.eigh(spread)[1][:, ::-1][:, :axes].copy())


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotate: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each row, and how many distances were verified."""
    c_lead, c_rest = rotate(centroids.astype(float))
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    # rounding grows with the sizes of what is subtracted
    reach = (lead**2).sum(axis=1) + rest**2
    margin = 1e-9 * (reach[:, None] + ((c_lead**2).sum(axis=1) + c_rest**2)[None]) + 1.0
    bound -= margin

    def exact(rows: np.ndarray, numbers) -> np.ndarray:
        return ((v[rows] - centroids[numbers]) ** 2).sum(axis=1)

    everyone = np.arange(len(v))
    cluster = bound.argmin(axis=1)
    distance, verified = exact(everyone, cluster), len(v)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= distance) & (cluster != j))
        if len(rows):
            d = exact(rows, j)
            verified += len(rows)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
            cluster[rows[closer]], distance[rows[closer]] = j, d[closer]
    return cluster, distance, verified


def _assign(batches: Iterator, centroids: np.ndarray, rotate: Rotation) -> Iterator:
    """Each batch of prepared rows with its vectors, clusters and distances."""
    for batch in batches:
        if batch.num_rows:
            v, lead = _matrix(batch.column("v")).astype(np.int64), _matrix(batch.column("lead"))
            yield batch, v, *nearest(v, lead, batch.column("rest").to_numpy(), centroids, rotate)


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of `seed:vec_id`; of equal hashes the smaller vector."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.select(F.sha2(named, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in sorted(first, key=lambda r: (r["h"], r["v"]))]


class Prepared:
    """The kept vectors with their rotated coordinates, written once."""

    def __init__(self, vectors: DataFrame, size: int, axes: int, scratch: Scratch):
        plain = scratch.write(vectors).df
        low, high = plain.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        if low is not None and (low < -LARGEST or high > LARGEST):
            raise ValueError(f"components from {low} to {high} go beyond {LARGEST}: squared distances may not fit into a long")
        self.rotate, self.size = rotation(plain, size, axes), size
        rotate = self.rotate

        def turn(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                v = _matrix(batch.column("v"))
                lead, rest = rotate(v.astype(float))
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * lead.shape[1])
                small = batch.column("v").flatten().cast(pa.int32())
                ints = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), small)
                turned = pa.ListArray.from_arrays(ends, pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), ints, turned, pa.array(rest)], ["vec_id", "v", "lead", "rest"])

        kind = dict(plain.dtypes)["vec_id"]
        self.df = scratch.write(plain.mapInArrow(turn, f"vec_id {kind}, v array<int>, lead array<double>, rest double")).df
        self.kind, self.plain = kind, plain

    def sums(self, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
        """Size and componentwise sum of each non-empty cluster."""
        rotate, size = self.rotate, self.size

        def add(batches: Iterator) -> Iterator:
            import pyarrow as pa

            totals, sizes = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64)
            for _, v, cluster, _, _ in _assign(batches, centroids, rotate):
                for j in np.unique(cluster).tolist():
                    totals[j] += v[cluster == j].sum(axis=0)
                    sizes[j] += (cluster == j).sum()
            used = np.flatnonzero(sizes)
            at = np.tile(np.arange(-1, size), len(used))
            values = np.hstack([sizes[used, None], totals[used]]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(used, size + 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(values)],
                ["cluster", "at", "value"],
            )

        rows = self.df.select("v", "lead", "rest").mapInArrow(add, "cluster int, at int, value long")
        # sums of many tasks may leave the range of a long
        added = rows.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        found: dict[int, dict[int, int]] = {}
        for r in added.collect():
            found.setdefault(r["cluster"], {})[r["at"]] = int(r["value"])
        return {j: (x[-1], [x[i] for i in range(size)]) for j, x in found.items()}

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """`(vec_id, cluster, distance)` of all vectors."""
        rotate = self.rotate

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch, _, cluster, distance, _ in _assign(batches, centroids, rotate):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

        return self.df.mapInArrow(run, f"vec_id {self.kind}, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, axes: int = AXES) -> DataFrame:
    """`(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)` of the kept vectors of `vectors(vec_id, embedding)`.

    Kept are vectors of `size` finite components; null, short, long and non-finite ones are
    left out. Equal vectors and repeated ids count as rows of their own; a null id is
    hashed as an empty text. Of equally near centroids the smaller number wins; a
    centroid without vectors stays where it is. With fewer than k vectors there are so
    many centroids; an empty table gives no row. Other columns are ignored. A component beyond
    2^27 after scaling is an error, as distances would not fit into a long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    held = Prepared(integers(vectors, size, scale), size, axes, scratch)
    centres = _first_centroids(held.plain, k, seed)
    for _ in range(rounds if centres else 0):
        moved = [list(c) for c in centres]
        for j, (n, total) in held.sums(np.array(centres, np.int64)).items():
            moved[j] = [x // n for x in total]
        if moved == centres:
            break  # every further round is the same
        centres = moved
    if not centres:
        schema = f"vec_id {held.kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    found = scratch.write(held.assigned(np.array(centres, np.int64))).df
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    told = spark.createDataFrame([(j, s, sum(per.values()), digests[j]) for j, s in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
