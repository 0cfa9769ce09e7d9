"""All registered queries and their SQL."""

from __future__ import annotations

from terravane.plans import scenes  # noqa: F401  registers its queries
from terravane.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
