"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.plans import catalogue, control, more  # noqa: F401  control and more add their queries to the catalogue

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)
