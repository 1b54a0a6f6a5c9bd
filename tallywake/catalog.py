"""Every query of the library by name, and the SQL that says the same."""

from __future__ import annotations

from .plans import files, imports, merges, reads, scalars, sync, writes  # noqa: F401  they register their queries
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
