"""Loads every module that registers queries."""

from __future__ import annotations

from waymark.plans import candidate_queries, codec_queries, exact_queries, more_queries, network_queries, report_queries, routing_queries, trace_queries  # noqa: F401
from waymark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
