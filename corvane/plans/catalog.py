"""All registered queries of the engine proper."""

from . import analysis_queries, corpus_queries, relational_queries, retrieval_queries, rule_queries, shard_queries, state_queries, flow_queries  # noqa: F401  registration
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
