"""All queries of the core library and their SQL."""

from __future__ import annotations

from . import agent_queries, core_problems, evidence_queries, report_queries, retrieval_queries, text_queries

_MODULES = (core_problems, text_queries, retrieval_queries, evidence_queries, report_queries, agent_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
FLAGSHIP = "bm25_recall_at_10"
