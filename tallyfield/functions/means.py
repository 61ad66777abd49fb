"""Means that do not depend on the order of tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_sum(value: Column | str) -> Column:
    """The exact sum of whole numbers, beyond the bigint range."""
    column = F.col(value) if isinstance(value, str) else value
    return F.sum(column.cast("decimal(20,0)"))


def whole_mean(value: Column | str) -> Column:
    """The mean of whole numbers: an exact sum, divided once; null where there are none."""
    return F.try_divide(whole_sum(value).cast("double"), F.count(value))
