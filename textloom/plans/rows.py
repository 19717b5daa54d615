"""Queries over raw rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import rowparse
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can't be loaded by the specification of their input, with the reason."""
    return rowparse.failures(table(spark, sf_dir, "raw_rows"), table(spark, sf_dir, "inputs"))


QUERIES["p5_found"] = p5_found
