"""Edgewise: graph, table and stream analytics as Spark jobs."""
