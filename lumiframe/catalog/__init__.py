"""Registered queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from . import file_queries, metric_queries, model_queries, prepare_queries, projection_queries, result_queries, store_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries() -> tuple[dict, dict]:
    return QUERIES, ORACLES
