"""Imports every module that registers queries."""

from factloom.tables import code_queries, module_queries, relation_queries, text_queries  # noqa: F401
from factloom.tables.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
