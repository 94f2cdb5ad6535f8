"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    benchmark_queries,
    entity_queries,
    extraction_queries,
    graph_build_queries,
    graph_queries,
    linking_queries,
    quality_queries,
    search_queries,
    store_queries,
    table_queries,
    text_queries,
    vocabulary_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
