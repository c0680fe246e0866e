"""All core queries: importing this module registers them."""

from __future__ import annotations

from corpusloom.plans import chat_queries, eval_queries, model_queries, numeric_queries, state_queries, stream_queries
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chat_queries", "eval_queries", "model_queries", "numeric_queries", "state_queries", "stream_queries"]
