"""Imports every query module."""

from fieldloom.plans import (  # noqa: F401
    expression_queries,
    grid_queries,
    learning_queries,
    series_queries,
    table_queries,
)
from fieldloom.plans.registry import ORACLES, QUERIES  # noqa: F401
