"""All of the engine's own queries and their SQL counterparts."""

from __future__ import annotations

from . import conditions, dialogue, evaluation, planning, series, trees  # noqa: F401  (they register themselves)
from .registry import QUERIES, SQL

FLAGSHIP = "tree_context_block"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
