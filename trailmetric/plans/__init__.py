"""Registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, extraction, facts, further, more, outside, people, records, steps, units

_PARTS = (facts, people, records, steps, more, checks, further, units, extraction, outside)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.Q.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.S.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations per length band: turns as ordered steps, banded by their count."""
    return QUERIES["conversation_bands"](spark, sf_dir)
