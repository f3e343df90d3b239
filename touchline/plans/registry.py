"""All queries of the engine and their SQL equivalents."""

from __future__ import annotations

from . import fitted, passes, people, relational, zones  # noqa: F401  modules register on import
from .base import ORACLES, QUERIES

FLAGSHIP = "x01_xt_value_iteration"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
