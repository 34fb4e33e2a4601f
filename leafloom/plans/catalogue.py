"""All queries of the core and their SQL."""

from __future__ import annotations

from leafloom.plans import accounting, aligning, comparing, describing, nesting, preparing  # noqa: F401
from leafloom.plans.registry import QUERIES, SQL  # noqa: F401
