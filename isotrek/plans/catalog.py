"""All queries of the core, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isotrek.plans import problems, problems_sql, reference, reference_sql, tables, tables_sql

FLAGSHIP = "hop_median"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return problems.QUERIES | reference.QUERIES | tables.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems_sql.SQL | reference_sql.SQL | tables_sql.SQL
