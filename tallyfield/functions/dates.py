"""Dates from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted date format.
DATE_FORMAT = "yyyy-MM-dd"


def try_date(text: Column, pattern: str = DATE_FORMAT) -> Column:
    """The date, or null for text that is not exactly a date in the pattern."""
    if pattern == DATE_FORMAT:
        # The cast is several times as fast as a pattern parser, but also takes other forms.
        return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))
    return F.try_to_date(text, pattern)
