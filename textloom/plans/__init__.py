"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    from textloom.plans import counting, factors, hypotheses, modelling, rewriting

    return [counting, modelling, hypotheses, rewriting, factors]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from textloom.plans.sql import materialised

    return {k: materialised(s) for m in _modules() for k, s in m.SQL.items()}
