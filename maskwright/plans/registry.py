"""All queries of the library, by name, and the SQL each is held against."""

from __future__ import annotations

from maskwright.plans import oracles, queries, service_oracles, services

QUERIES = queries.QUERIES | services.QUERIES
ORACLES = oracles.ORACLES | service_oracles.ORACLES

__all__ = ["ORACLES", "QUERIES"]
