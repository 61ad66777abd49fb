"""Concurrency: how many requests or users are open at once.

A span is open from its start up to, not including, its end. One without an end is still open
and stays so; one without a start has not begun and is not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.joins import attach_over
from tallyfield.operators.running import BLOCK_BITS, fold_peaks, running_peak, running_total

# Blocks are cut twice, which bounds the top level for instants in any unit, nanoseconds included.
LEVELS = 2


def open_changes(
    spans: DataFrame,
    keys: Sequence[str] = ("run_id",),
    start: str = "start_ms",
    end: str = "end_ms",
) -> DataFrame:
    """Net change in open spans per key and instant, from one scan of the spans."""
    edges = F.array(
        F.struct(F.col(start).alias("at_ms"), F.lit(1).cast("bigint").alias("change")),
        F.struct(F.col(end).alias("at_ms"), F.lit(-1).cast("bigint").alias("change")),
    )
    begun = spans.where(F.col(start).isNotNull())
    return (
        begun.select(*keys, F.inline(edges))
        .where(F.col("at_ms").isNotNull())
        .groupBy(*keys, "at_ms")
        .agg(F.sum("change").alias("change"))
    )


def open_requests(
    spans: DataFrame,
    keys: Sequence[str] = ("run_id",),
    start: str = "start_ms",
    end: str = "end_ms",
    bits: int = BLOCK_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """Open spans after each instant at which one starts or ends."""
    changes = open_changes(spans, keys, start, end)
    done = running_total(changes, keys, "at_ms", "change", "open", bits=bits, levels=levels)
    return done.select(*keys, "at_ms", "change", "open")


def max_open(
    spans: DataFrame,
    keys: Sequence[str] = ("run_id",),
    start: str = "start_ms",
    end: str = "end_ms",
    bits: int = BLOCK_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """The largest number of spans open at once, per key or, with no keys, overall."""
    changes = open_changes(spans, keys, start, end)
    return running_peak(changes, keys, "at_ms", "change", "max_open", bits, levels)


def open_series(
    spans: DataFrame,
    max_points: int = 1000,
    run: str = "run_id",
    start: str = "start_ms",
    end: str = "end_ms",
    bits: int = BLOCK_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """Open spans over each run, cut into at most ``max_points`` steps: peak and mean of each step.

    A run lasts from its first start to its last start or end; ``point`` p covers the instants from
    ``from_ms`` up to, not including, ``to_ms``, and every step has a row, also where nothing starts
    or ends. ``area`` is the time that all spans were open in the step, in whole milliseconds of
    spans; ``mean_open`` is that by the length of the step. A span without an end is open to the
    end of the run.

    No span is copied into the steps it covers. A change of c at t adds c for the rest of its own
    step, and c to all later steps, which is a running sum over one row per step.
    """
    changes = open_changes(spans, [run], start, end)
    placed = attach_over(
        changes, [run], F.shiftright("at_ms", bits), __first=(F.min, "at_ms"), __last=(F.max, "at_ms")
    )
    points = int(max_points)
    length = "(__last - __first + 1)"
    point = f"(at_ms - __first) * {points} div {length}"

    def begins(p: str) -> str:
        """The first instant whose point is ``p`` or more."""
        return f"__first + ({p} * {length} + {points - 1}) div {points}"

    cells = placed.withColumn("__point", F.expr(point)).withColumn(
        "__rest", F.expr(f"cast(change as decimal(38,0)) * ({begins('(__point + 1)')} - at_ms)")
    )
    keys = [run, "__first", "__last", "__point"]
    steps = fold_peaks(cells, keys, "at_ms", "change", ["__rest"], bits, levels)
    # At most max_points rows of a run from here on.
    whole = Window.partitionBy(run).orderBy("__point")
    before = F.coalesce(F.sum("net").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.coalesce(F.lead("__point").over(whole), F.lit(points))
    filled = steps.select("*", before.alias("__before"), following.alias("__next")).select(
        "*", F.explode(F.sequence("__point", F.col("__next") - 1)).alias("point")
    )
    from_ms, to_ms = F.expr(begins("point")), F.expr(begins("(point + 1)"))
    own = F.col("point") == F.col("__point")
    carried = F.col("__before") + F.when(own, 0).otherwise(F.col("net"))
    # The level carried in counts as a peak only if it lasts into the step.
    lasts = F.when(~own | (F.col("first_at") > from_ms), carried)
    reached = F.when(own, F.col("__before") + F.col("peak"))
    area = (to_ms - from_ms) * carried.cast("decimal(28,0)") + F.when(own, F.col("__rest")).otherwise(0)
    return filled.select(
        run,
        "point",
        from_ms.alias("from_ms"),
        to_ms.alias("to_ms"),
        F.greatest(lasts, reached).cast("bigint").alias("peak"),
        area.cast("decimal(38,0)").alias("__area"),
    ).where(F.col("to_ms") > F.col("from_ms")).select(
        run, "point", "from_ms", "to_ms", "peak",
        F.col("__area").cast("bigint").alias("area"),
        (F.col("__area").cast("double") / (F.col("to_ms") - F.col("from_ms"))).alias("mean_open"),
    )
