"""Query keys of the core operators, with their SQL equivalents."""

from __future__ import annotations

from .oracles_runs import ORACLES
from .queries import QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
