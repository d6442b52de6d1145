"""Registered queries: the library's operators applied to the driver's tables."""

import importlib

from .registry import QUERIES, SQL

MODULES = (
    "operations_queries",
    "review_queries",
    "triage_queries",
    "source_queries",
    "listing_queries",
    "signal_queries",
    "stream_queries",
)

for _name in MODULES:
    importlib.import_module(f".{_name}", __name__)

__all__ = ["QUERIES", "SQL"]
