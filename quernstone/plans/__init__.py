"""Named queries over the bound tables, each beside the SQL that checks it."""

from . import analytics_queries, code_queries, graph_queries, lifecycle_queries, record_queries, retrieval_queries, stream_queries  # noqa: F401
from .registry import COVERS, ORACLE, QUERIES

__all__ = ["COVERS", "ORACLE", "QUERIES"]
