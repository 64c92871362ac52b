"""All registered queries and their oracles, by name."""

from __future__ import annotations

from .plans import compare, derived, durable, episodes, evaluate, ingest, leaks, more, patching, relate, text_queries, trajectories  # noqa: F401  they register
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
