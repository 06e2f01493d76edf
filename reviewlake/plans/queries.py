"""All registered queries."""

from . import code_queries, report_queries  # noqa: F401  (both register on import)
from .registry import QUERIES

__all__ = ["QUERIES"]
