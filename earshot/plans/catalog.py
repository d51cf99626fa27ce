"""All registered queries. Importing the query modules registers them."""

from earshot.plans import (  # noqa: F401
    queries_correction,
    queries_metrics,
    queries_sessions,
    queries_signal,
    queries_sources,
    queries_text,
)
from earshot.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
