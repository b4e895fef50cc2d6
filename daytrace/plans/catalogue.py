"""All registered queries."""

from daytrace.plans import (  # noqa: F401
    core_queries,
    ingest_queries,
    stream_queries,
    summary_queries,
    text_queries,
)
from daytrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
