"""Feature tables: loading them and naming them for SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The view names that existing SQL text uses.
EXPOSURE_VIEW = "siteexposure_event"
LOSS_VIEW = "sitelossanalyzevent"


def load_feature(
    spark: SparkSession,
    table: str,
    feature: str | None = None,
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
    feature_column: str | None = None,
    **options: str,
) -> DataFrame:
    """Load a feature table lazily.

    ``columns`` maps feature column names to stored ones. Where one table holds several
    features, ``feature_column`` names the column that tells them apart and ``feature`` the
    one wanted; the filter on it reaches the scan, and prunes folders if the table is
    partitioned by it. A table with a single feature needs neither.
    """
    if (feature is None) != (feature_column is None):
        raise ValueError("feature and feature_column go together")
    loaded = spark.read.format(fmt).options(**options).load(table)
    if feature_column is not None:
        loaded = loaded.where(F.col(feature_column) == feature)
    if columns is not None:
        loaded = loaded.select(*[F.col(stored).alias(name) for name, stored in columns.items()])
    return loaded


def register(df: DataFrame, name: str) -> None:
    """Name a DataFrame for SQL in its own session."""
    df.createOrReplaceTempView(name)
