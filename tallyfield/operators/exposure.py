"""Largest coverage sum per site, and its bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.exposure import (
    BIN_COUNT,
    BIN_FUNCTION,
    BIN_HIGH,
    BIN_LOW,
    COVERAGES,
    coverage_sum,
    exposure_bin,
    register_functions,
)
from tallyfield.sources.features import EXPOSURE_VIEW, LOSS_VIEW, register
from tallyfield.sources.views import chain

SITE_KEYS = ("portfolio_id", "site_id")

# The view names under which existing SQL text finds the two results.
MAX_VIEW = "myview"
BIN_VIEW = "myview1"


def max_exposure(
    exposure: DataFrame, keys: Sequence[str] = SITE_KEYS, coverages: Sequence[str] = COVERAGES
) -> DataFrame:
    """MAX of the coverage sum per key. Each task reduces its rows before the one shuffle."""
    return exposure.groupBy(*keys).agg(F.max(coverage_sum(coverages)).alias("max_10"))


def exposure_bins(
    exposure: DataFrame,
    keys: Sequence[str] = SITE_KEYS,
    coverages: Sequence[str] = COVERAGES,
    low: float = BIN_LOW,
    high: float = BIN_HIGH,
    count: int = BIN_COUNT,
) -> DataFrame:
    """The largest coverage sum per key and the equal-width bin it falls in."""
    return bin_maxima(max_exposure(exposure, keys, coverages), keys, low, high, count)


def bin_maxima(
    largest: DataFrame,
    keys: Sequence[str] = SITE_KEYS,
    low: float = BIN_LOW,
    high: float = BIN_HIGH,
    count: int = BIN_COUNT,
) -> DataFrame:
    """The bin of each largest coverage sum, just computed or kept."""
    return largest.select(
        "max_10", exposure_bin(F.col("max_10"), low, high, count).alias("BIN"), *keys
    )


def exposure_bin_steps(
    low: float = BIN_LOW, high: float = BIN_HIGH, count: int = BIN_COUNT
) -> list[tuple[str, str]]:
    """The same work as chained SQL over the exposure view; needs ``register_functions``."""
    total = " + ".join(COVERAGES)
    keys = ", ".join(SITE_KEYS)
    return [
        (MAX_VIEW, f"SELECT max({total}) AS max_10, {keys} FROM {EXPOSURE_VIEW} GROUP BY {keys}"),
        (
            BIN_VIEW,
            f"SELECT max_10, {BIN_FUNCTION}(max_10, {float(low)}D, {float(high)}D, {count}) AS BIN, "
            f"{keys} FROM {MAX_VIEW}",
        ),
    ]


def prepare_views(
    session: SparkSession,
    exposure: DataFrame,
    loss: DataFrame,
    low: float = BIN_LOW,
    high: float = BIN_HIGH,
    count: int = BIN_COUNT,
) -> DataFrame:
    """Make a session ready for analysts' SQL; return the bins.

    Registers the bin function, both feature views, and the two result views. Nothing runs
    until a statement asks for rows.
    """
    register_functions(session)
    register(exposure, EXPOSURE_VIEW)
    register(loss, LOSS_VIEW)
    return chain(session, exposure_bin_steps(low, high, count))


def peek(df: DataFrame, order: Sequence[str] | None = None, n: int = 1) -> DataFrame:
    """``n`` rows: any, reading no more than they need, or the first by ``order``.

    With an order each task keeps only its own first ``n``, but all rows are read.
    """
    return (df if order is None else df.orderBy(*order)).limit(n)
