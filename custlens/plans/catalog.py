"""All registered queries (importing the q_* modules registers them)."""

from __future__ import annotations

from . import flagship, q_clean, q_clv, q_ml, q_prep, q_reports, q_rfm, q_sources, q_stats  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
