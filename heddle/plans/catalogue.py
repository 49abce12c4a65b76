"""All of the library's own queries; importing this module registers them."""

from heddle.plans import graph_queries, matrix_queries, metric_queries, model_queries, sequence_queries, text_queries  # noqa: F401
from heddle.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
