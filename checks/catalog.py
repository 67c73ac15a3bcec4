"""All registered queries, in one place."""

from __future__ import annotations

from checks import feedback_queries, model_queries, report_queries, source_queries  # noqa: F401  (they register their queries)
from checks.registry import QUERIES, forget

__all__ = ["QUERIES", "forget"]
