"""Whole plans, and the registry of named queries."""

from graphloom.plans import detector_queries, eval_queries, experiment_queries, graph_queries, text_queries
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "detector_queries", "eval_queries", "experiment_queries", "graph_queries", "text_queries"]
