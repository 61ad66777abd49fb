"""Whole-text pattern matching."""

from __future__ import annotations

from pyspark.sql import Column


def full_match(text: Column, pattern: str) -> Column:
    """True when the pattern matches the whole text; a dot also matches line breaks."""
    return text.rlike(rf"(?s)\A(?:{pattern})\z")
