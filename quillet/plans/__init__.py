"""Registered queries of the table and document operators."""

from . import documents  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
