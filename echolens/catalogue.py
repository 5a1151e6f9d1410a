"""Every query of the decision engine, by name, with the SQL that it is held against."""

from __future__ import annotations

from .plans import contract_queries, decision_queries, gold_queries, ordering_queries, recall_queries, state_queries, text_queries  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "decisions_end_to_end"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
