"""The registered queries."""

from tickloom.plans import feature_tables, learning, monitoring, statistics, streams, tables, training, windows  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
