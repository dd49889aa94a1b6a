"""All queries of the engine and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from chunkloom.plans import delta, dedup, lifecycle, models, month, resemblance, rewriting, search, store, streams  # noqa: F401  (they register their queries)
from chunkloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
