"""Registered queries of the extraction engine and their SQL equivalents."""

from __future__ import annotations

from . import made_pages  # noqa: F401  registers its queries
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "page_records"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
