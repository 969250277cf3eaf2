"""All registered queries of the measuring operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from kinescape.plans import images, relational, streams

    return relational, images, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
