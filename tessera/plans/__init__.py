"""The query catalogue."""

from . import batches, experiments, scoring, streams  # noqa: F401
from .registry import OPERATORS, QUERIES, SQL

__all__ = ["OPERATORS", "QUERIES", "SQL"]
