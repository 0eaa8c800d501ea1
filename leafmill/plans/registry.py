"""All queries of the library's own operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from leafmill.plans._base import ORACLES, QUERIES
from leafmill.plans import canon, cleaning, context, governance, outline, review, search, sources, structure, streams, usage  # noqa: F401  each registers its queries

__all__ = ["ORACLES", "QUERIES", "Callable"]
