"""All registered queries."""

from sunledger.queries import analytics, ingest, models, prediction  # noqa: F401
from sunledger.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
