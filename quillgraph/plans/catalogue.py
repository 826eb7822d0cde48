"""All queries of the reference's own operators: importing this module fills the registry."""

from quillgraph.plans import graph_queries, text_queries  # noqa: F401
from quillgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
