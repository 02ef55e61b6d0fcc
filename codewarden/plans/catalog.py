"""All registered queries."""

from codewarden.plans import (  # noqa: F401
    class_queries,
    line_queries,
    metric_queries,
    packing_queries,
    row_queries,
    scoring_queries,
    source_queries,
)
from codewarden.plans import range_queries  # noqa: F401  builds on the others
from codewarden.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
