"""The registered queries and their oracle SQL, by inventory ID."""

from granary.queries import aggregates, arrows, events, further, graphs, lookups, retrieval, sources, texts  # noqa: F401
from granary.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
