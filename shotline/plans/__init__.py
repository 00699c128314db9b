"""Registered queries and their ANSI SQL twins."""

from shotline.plans.base import QUERIES, SQL
from shotline.plans import catalog_queries, event_queries, metric_queries, operation_queries, stream_queries, vector_queries

__all__ = ["QUERIES", "SQL"]
