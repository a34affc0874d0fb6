"""Registered queries over the driver's tables, with their DuckDB oracles."""

from . import (  # noqa: F401
    batch_queries,
    file_queries,
    line_queries,
    model_queries,
    score_queries,
    session_queries,
    stream_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
