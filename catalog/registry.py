"""All registered queries and their SQL."""

from catalog import (  # noqa: F401  (importing registers)
    agg_queries,
    columns,
    filters,
    join_queries,
    ordered_queries,
    plan_queries,
    resample_queries,
    scalar_queries,
    scans,
)
from catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
