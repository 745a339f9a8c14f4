"""All queries of the engine with their SQL, gathered from the plan modules."""

from __future__ import annotations

from vivaspark.plans import belief, calibrate, contracts, delivery, features, metrics, relational, resampling, sequence, sources, streams, text  # noqa: F401
from vivaspark.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
