"""Imports every query module so the registry is complete."""

from . import batch_queries, composite_queries, merge_queries, metric_queries, profile_queries, selection_queries, sequence_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
