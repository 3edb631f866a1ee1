"""Registered queries of the library."""

from kpi_spark.plans import measurement, series, tables  # noqa: F401
from kpi_spark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
