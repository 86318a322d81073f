"""Every named query of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from tessera import plans  # noqa: F401  registers the queries
from tessera.registry import QUERIES, SQL

FLAGSHIP = "d05_retention_curve"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
