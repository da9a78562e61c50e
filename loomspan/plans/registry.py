"""All queries of the reference's operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import relational, reports, synthetic


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**relational.QUERIES, **synthetic.QUERIES, **reports.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.SQL, **synthetic.SQL, **reports.SQL}
