"""Imports every query module; the registry fills as a side effect."""

from tidemark.plans import (  # noqa: F401
    attribution_queries,
    check_queries,
    metric_queries,
    panel_queries,
    relational_queries,
    scalar_queries,
    window_queries,
)
from tidemark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
