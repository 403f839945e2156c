"""Registered queries with their SQL."""

from lexspark.plans import operators
from lexspark.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "operators"]
