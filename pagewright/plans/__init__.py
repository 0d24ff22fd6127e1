"""Queries over the driver's tables; importing this package registers them all."""

from . import documents, exports, fonts, queries, reports, revisions
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "exports", "fonts", "queries", "reports", "revisions"]
