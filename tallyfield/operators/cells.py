"""Percentiles off logarithmic cells: counts that add up, with a relative error that is known.

A time keeps its leading ``bits`` + 1 binary digits; times with the same ones share a cell. So a cell is
at most 1 / 2**bits as wide as its times are long, a key has some hundred cells whatever its number of
requests, and cells of parts, runs or days add up to those of the whole. All is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.reqlog import PERCENTS, percent_name

BITS = 5


def relative_error(bits: int = BITS) -> float:
    """The most by which a percentile off cells differs from the true one, as a share of it."""
    return 1 / (1 << (bits + 1))


def rt_cells(log: DataFrame, keys: Sequence[str] = ("name",), bits: int = BITS) -> DataFrame:
    """Requests per key and cell: ``cell_ms`` is the cell's time nearest to 0, ``width_ms`` its length.

    Negative times have cells of their own, which mirror the others. Each task counts its own
    requests first, so the one shuffle has at most some hundred rows a key and task.
    """
    shift = f"greatest(length(bin(abs(rt_ms))) - {bits + 1}, 0)"
    start = f"cast(sign(rt_ms) as bigint) * shiftleft(shiftright(abs(rt_ms), {shift}), {shift})"
    return (
        log.where(F.col("rt_ms").isNotNull())
        .groupBy(*keys, F.expr(start).alias("cell_ms"), F.expr(f"shiftleft(1L, {shift})").alias("width_ms"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def cell_percentiles(
    cells: DataFrame, percents: Sequence[float] = PERCENTS, keys: Sequence[str] = ("name",)
) -> DataFrame:
    """Percentiles per key off the cells of any number of parts.

    A percentile is the middle of the cell that holds the least time which at least that share of all
    times does not exceed, so it is off by ``relative_error`` at most. A key has at most
    2**(bits + 7) cells, which is what a window holds.
    """
    whole = cells.groupBy(*keys, "cell_ms", "width_ms").agg(F.sum("requests").alias("__n"))
    up = Window.partitionBy(*keys).orderBy("cell_ms")
    counted = whole.withColumns(
        {"__upto": F.sum("__n").over(up), "__all": F.sum("__n").over(Window.partitionBy(*keys))}
    )
    middle = F.expr("cell_ms + cast(sign(cell_ms) as bigint) * ((width_ms - 1) div 2)")
    found = []
    for p in percents:
        rank = F.greatest(F.ceil(F.col("__all") * F.lit(p / 100.0)), F.lit(1))
        here = (rank > F.col("__upto") - F.col("__n")) & (rank <= F.col("__upto"))
        found.append(F.max(F.when(here, middle)).cast("bigint").alias(percent_name(p)))
    return counted.groupBy(*keys).agg(F.max("__all").alias("requests"), *found)
