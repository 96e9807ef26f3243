"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import agenda, blocks, catalogue, corpus, documents, feeds, grading, lookup, partners, planning, schedule, search, text  # noqa: F401  (they declare their queries)
from quern.plans.declare import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
FLAGSHIP = "bm25f_topk"
