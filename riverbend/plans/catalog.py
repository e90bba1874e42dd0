"""All registered queries of the time-series engine and their DuckDB counterparts."""

from __future__ import annotations

from . import explaining, extras, scoring, series, streams
from .scoring import flagship

QUERIES = {**series.QUERIES, **scoring.QUERIES, **explaining.QUERIES, **streams.QUERIES, **extras.QUERIES}
ORACLE = {**series.ORACLE, **scoring.ORACLE, **explaining.ORACLE, **streams.ORACLE, **extras.ORACLE}
__all__ = ["ORACLE", "QUERIES", "flagship"]
