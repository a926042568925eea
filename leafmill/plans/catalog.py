"""All registered queries of the document engine."""

from __future__ import annotations

from . import documents, files, inferred, more, pages, quality, sheets, text  # noqa: F401  (they register their queries)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
