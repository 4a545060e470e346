"""Property graph: a vertex table `(id, ...)` and an edge table `(src, dst, ...)`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from edgewise.operators import components, edges as E, rank, triangles
from edgewise.plans import skew
from edgewise.plans.scratch import Scratch


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame

    def triplets(self) -> DataFrame:
        """Edges with the attributes of both ends, as structs `source` and `target`."""
        edges, degrees, total = self._stored()
        rows = self._with_end(edges, "src", "source", degrees, total)
        return self._with_end(rows, "dst", "target", degrees, total)

    def _stored(self) -> tuple[DataFrame, DataFrame | None, int]:
        """The edges from files, so that they are made once, their number, and above the limit of hot keys the degrees.

        Both degrees of all nodes come from one pass.
        """
        scratch, told = Scratch(self.edges.sparkSession, "graph"), Observation()
        edges = scratch.write(self.edges.observe(told, F.count(F.lit(1)).alias("n"))).df
        total = told.get["n"]
        if total <= skew.MIN_HOT_ROWS:
            return edges, None, total
        ends = edges.select(F.explode(F.array(F.struct("src", F.lit(1).alias("out")), F.struct(F.col("dst").alias("src"), F.lit(0).alias("out")))).alias("e"))
        degrees = ends.groupBy("e.src").agg(F.sum("e.out").alias("src_n"), F.sum(1 - F.col("e.out")).alias("dst_n"))
        return edges, scratch.write(degrees.select(F.col("src").alias("node"), "src_n", "dst_n")).df, total

    def _with_end(self, rows: DataFrame, end: str, name: str, degrees: DataFrame | None, total: int) -> DataFrame:
        """`rows` with the vertex at `end`; a vertex with very many edges keeps its rows spread."""
        attrs = [c for c in self.vertices.columns if c != "id"]
        side = self.vertices.select(F.col("id").alias(end), F.struct("id", *attrs).alias(name))
        return self._joined(rows, side, end, degrees, total)

    def _joined(self, rows: DataFrame, side: DataFrame, end: str, degrees: DataFrame | None, total: int) -> DataFrame:
        if degrees is None:
            return rows.join(side, end)
        side = side.join(degrees.select(F.col("node").alias(end), F.col(f"{end}_n").alias("_n")).where("_n > 0"), end)
        return skew.join_counted(rows, side, [end], "_n", total)

    def aggregate_messages(
        self, where: Column, messages: dict[str, Column], aggregates: Sequence[Column]
    ) -> DataFrame:
        """Send `messages` along the triplets that pass `where`, combine at `dst`.

        Vertices that get no message are absent from the result.
        """
        sent = self.triplets().where(where).select(
            F.col("dst").alias("id"), *[m.alias(n) for n, m in messages.items()]
        )
        return sent.groupBy("id").agg(*aggregates)

    def join_vertices(self, attributes: DataFrame, defaults: dict[str, object]) -> "PropertyGraph":
        """Outer join of attributes to the vertices, with defaults for missing ones."""
        joined = self.vertices.join(attributes, "id", "left")
        for name, value in defaults.items():
            joined = joined.withColumn(name, F.coalesce(name, F.lit(value)))
        return PropertyGraph(joined, self.edges)

    def subgraph(self, where: Column) -> "PropertyGraph":
        """Vertices that pass, and the edges with both ends among them."""
        kept = self.vertices.where(where)
        ids = kept.select("id")
        edges, degrees, total = self._stored()
        inside = self._joined(edges, ids.withColumnRenamed("id", "src"), "src", degrees, total)
        inside = self._joined(inside, ids.withColumnRenamed("id", "dst"), "dst", degrees, total)
        return PropertyGraph(kept, inside.select(*self.edges.columns))

    def connected_components(self, **options) -> components.ComponentsResult:
        nodes = self.vertices.select(F.col("id").alias("node"))
        return components.connected_components(self.edges, vertices=nodes, **options)

    def pagerank(self, **options):
        return rank.pagerank(self.edges, **options)

    def triangle_counts(self) -> DataFrame:
        return triangles.triangles_per_vertex(self.edges)

    def degrees(self) -> DataFrame:
        return E.degrees(self.edges)

    def partition_by(self, strategy: str, parts: int) -> "PropertyGraph":
        """Lay the edges out by one of four edge-cut rules.

        `1d` keeps the edges of a source together, `2d` puts an edge into a cell
        of a square grid over both ends, `random` spreads them, `canonical`
        keeps both directions of a pair together.
        """
        side = max(1, round(parts**0.5))
        keys = {
            "1d": [F.xxhash64("src")],
            "2d": [
                F.pmod(F.xxhash64("src"), F.lit(side)) * side
                + F.pmod(F.xxhash64("dst"), F.lit(side))
            ],
            "random": [F.xxhash64("src", "dst")],
            "canonical": [F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))],
        }[strategy]
        return PropertyGraph(self.vertices, self.edges.repartition(parts, *keys))
