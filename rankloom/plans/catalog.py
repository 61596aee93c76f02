"""Named queries over the driver tables, each with an independent DuckDB statement."""

from __future__ import annotations

import importlib

from rankloom.plans.base import ORACLES, QUERIES

#: Modules whose import registers queries.
MODULES = ("rank_queries", "id_queries", "join_queries", "aggregate_queries", "score_queries", "stat_queries", "resample_queries", "inference_queries", "profile_queries", "count_queries", "graph_queries", "vector_queries", "event_queries", "model_queries", "null_queries", "contrast_queries")
for _m in MODULES:
    importlib.import_module(f"rankloom.plans.{_m}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
