"""Registered queries over the given tables, each with the SQL that must
return the same rows."""

from tallyfold.checks import ingest, reports, upkeep  # noqa: F401
from tallyfold.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
