"""Coverage sums and equal-width bins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Coverage columns, bin bounds, bin count and the SQL name of the bin function.
COVERAGES = ("cov1val", "cov2val", "cov3val", "cov4val")
BIN_LOW = 150.0
BIN_HIGH = 3990682000.0
BIN_COUNT = 99
BIN_FUNCTION = "WIDTH_BUCKET_1"


def coverage_sum(columns: Sequence[str] = COVERAGES) -> Column:
    """Left-to-right sum of the columns; null when any of them is null."""
    return reduce(add, [F.col(c) for c in columns])


def exposure_bin(
    value: Column, low: float = BIN_LOW, high: float = BIN_HIGH, count: int = BIN_COUNT
) -> Column:
    """Bin number 1..count; 0 below ``low``, count + 1 from ``high`` on, null for null and NaN."""
    return F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(count))


def register_functions(spark: SparkSession) -> None:
    """Give SQL text the bin function. It is a SQL function, so Catalyst inlines its body."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {BIN_FUNCTION}"
        "(v DOUBLE, low DOUBLE, high DOUBLE, n BIGINT) RETURNS BIGINT "
        "RETURN width_bucket(v, low, high, n)"
    )
