"""SQL statements over views, alone or chained."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyfield.sources.features import register


def run_sql(
    spark: SparkSession, sql: str, views: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Run a caller's SQL query, after naming the given DataFrames for it."""
    for name, df in (views or {}).items():
        register(df, name)
    return spark.sql(sql)


def chain(spark: SparkSession, steps: Iterable[tuple[str, str]]) -> DataFrame:
    """Run (view name, SQL) steps in order, each seeing the views before it; return the last."""
    result = None
    for name, sql in steps:
        result = spark.sql(sql)
        register(result, name)
    if result is None:
        raise ValueError("chain needs at least one step")
    return result
