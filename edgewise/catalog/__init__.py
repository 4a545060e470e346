"""Named queries over the driver tables, with their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ("components", "graph_jobs", "table_jobs", "file_jobs", "udf_jobs", "stream_jobs", "feature_jobs", "model_jobs")


def _load():
    from edgewise.catalog import registry

    for name in MODULES:
        importlib.import_module(f"edgewise.catalog.{name}")
    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
