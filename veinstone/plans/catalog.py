"""All queries of the library but those of training-data operators."""

from __future__ import annotations

from . import audit_queries, index_queries, overlap_queries, pipeline_queries, quality_queries, retrieval_queries, state_queries, text_queries
from .registry import Plan

_MODULES = (text_queries, retrieval_queries, state_queries, overlap_queries, quality_queries, pipeline_queries, index_queries, audit_queries)


def queries() -> dict[str, Plan]:
    return {name: plan for m in _MODULES for name, plan in m.registry.plans.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.registry.sql.items()}
