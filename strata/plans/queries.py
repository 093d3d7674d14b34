"""All registered queries: importing the modules fills the registry."""

from __future__ import annotations

from strata.plans import event_queries, graph_queries, more_queries, text_queries, tool_queries  # noqa: F401
from strata.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
