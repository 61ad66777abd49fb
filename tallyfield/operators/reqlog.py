"""Aggregates over the request log of a load test.

The log has the columns of ``tallyfield.sources.reqlog.REQUEST_SCHEMA``. Groupings carry
partial aggregates through the shuffle, so a hot run or name costs no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.means import whole_mean, whole_sum
from tallyfield.operators.joins import attach_over
from tallyfield.operators.running import BLOCK_BITS, running_total

# Status marks, time limit of a server request, indicator bounds, percentiles,
# histogram cell, points per series, and the two service goals.
OK = "OK"
KO = "KO"
SERVER_LIMIT_MS = 40_000
LOWER_BOUND_MS = 800
HIGHER_BOUND_MS = 1200
PERCENTS = (50, 75, 95, 99)
CELL_MS = 10
MAX_POINTS = 1000
GOAL_MAX_MS = 50
GOAL_PERCENT = 95
ALL = "all"

# Parts into which the messages of one key are spread.
MESSAGE_PARTS = 1024


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _failed() -> Column:
    return F.col("status") == KO


def _succeeded() -> Column:
    return F.col("status") == OK


def _percent_ok() -> Column:
    return F.lit(100.0) * _count_if(_succeeded()) / F.count(F.lit(1))


def request_counts(log: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Requests, failures, percent succeeded, and uptime from first start to last end."""
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        _count_if(_failed()).alias("failed"),
        _percent_ok().alias("percent_ok"),
        (F.max("end_ms") - F.min("start_ms")).alias("uptime_ms"),
    )


def timed_out(
    log: DataFrame, limit_ms: int = SERVER_LIMIT_MS, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Requests that took longer than the limit."""
    return log.groupBy(*keys).agg(_count_if(F.col("rt_ms") > limit_ms).alias("timed_out"))


def error_summary(
    log: DataFrame, keys: Sequence[str] = ("run_id",), message: str = "message"
) -> DataFrame:
    """Failures per message and their share of all failures of the key, largest first."""
    counts = log.where(_failed()).groupBy(*keys, message).agg(F.count(F.lit(1)).alias("failures"))
    spread = F.pmod(F.xxhash64(message), F.lit(MESSAGE_PARTS))
    share = F.lit(100.0) * F.col("failures") / F.col("__all")
    return (
        attach_over(counts, keys, spread, __all=(F.sum, "failures"))
        .select(*keys, message, "failures", share.alias("percent"))
        .orderBy(F.desc("failures"), *keys, message)
    )


def rt_indicators(
    log: DataFrame,
    lower_ms: int = LOWER_BOUND_MS,
    higher_ms: int = HIGHER_BOUND_MS,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Successful requests below, between and from the bounds on, and failed requests."""
    rt = F.col("rt_ms")
    return log.groupBy(*keys).agg(
        _count_if(_succeeded() & (rt < lower_ms)).alias("below"),
        _count_if(_succeeded() & (rt >= lower_ms) & (rt < higher_ms)).alias("between"),
        _count_if(_succeeded() & (rt >= higher_ms)).alias("above"),
        _count_if(_failed()).alias("failed"),
    )


def percent_name(percent: float) -> str:
    return f"p{percent:g}".replace(".", "_")


def rt_percentiles(
    log: DataFrame,
    percents: Sequence[float] = PERCENTS,
    keys: Sequence[str] = ("name",),
    exact: bool = True,
    accuracy: int = 10_000,
    bits: int = BLOCK_BITS,
) -> DataFrame:
    """Percentiles of response time per key.

    Exact ones interpolate between neighbouring ranks. They are read off the running count of
    the distinct times, so no task holds the times of a whole key. Otherwise each key keeps a
    sketch of bounded size with rank error 1 / ``accuracy``.
    """
    timed = log.where(F.col("rt_ms").isNotNull())
    if not exact:
        sketch = F.percentile_approx("rt_ms", [p / 100.0 for p in percents], accuracy)
        return (
            timed.groupBy(*keys)
            .agg(sketch.alias("__p"))
            .select(
                *keys,
                *[
                    F.col("__p")[i].cast("double").alias(percent_name(p))
                    for i, p in enumerate(percents)
                ],
            )
        )
    times = timed.groupBy(*keys, "rt_ms").agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_total(times, keys, "rt_ms", "__n", "__upto", total="__all", bits=bits)
    at_rank, results = [], []
    for i, p in enumerate(percents):
        rank = (F.col("__all") - 1) * F.lit(p / 100.0)
        for side, r in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            here = (r >= F.col("__upto") - F.col("__n")) & (r < F.col("__upto"))
            at_rank.append(F.max(F.when(here, F.col("rt_ms"))).alias(f"__{side}{i}"))
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        between = low + (high - low) * (rank - F.floor(rank))
        results.append(between.cast("double").alias(percent_name(p)))
    found = ranked.groupBy(*keys).agg(F.max("__all").alias("__all"), *at_rank)
    return found.select(*keys, *results)


def rt_rollup(log: DataFrame, name: str = "name") -> DataFrame:
    """Response-time statistics per request name and over all names.

    Names are reduced first, so the rollup doubles a few rows and not the log.
    """
    per_name = log.groupBy(name).agg(
        F.count(F.lit(1)).alias("__requests"),
        _count_if(_succeeded()).alias("__ok"),
        _count_if(_failed()).alias("__ko"),
        F.min("rt_ms").alias("__min"),
        F.max("rt_ms").alias("__max"),
        whole_sum("rt_ms").alias("__sum"),
        F.count("rt_ms").alias("__timed"),
    )
    label = F.when(F.grouping(name) == 1, F.lit(ALL)).otherwise(F.col(name))
    return (
        per_name.rollup(name)
        .agg(
            label.alias("__label"),
            F.grouping(name).alias("__is_all"),
            F.sum("__requests").alias("requests"),
            F.sum("__ok").alias("ok"),
            F.sum("__ko").alias("ko"),
            F.min("__min").alias("min_ms"),
            F.max("__max").alias("max_ms"),
            F.try_divide(F.sum("__sum").cast("double"), F.sum("__timed")).alias("mean_ms"),
        )
        .select(
            F.col("__label").alias(name),
            (F.col("__is_all") == 1).alias("is_all"),
            "requests",
            "ok",
            "ko",
            "min_ms",
            "max_ms",
            "mean_ms",
        )
    )


def rt_histogram(
    log: DataFrame, cell_ms: int = CELL_MS, keys: Sequence[str] = ("name",)
) -> DataFrame:
    """Requests per response-time cell; a cell is told by its lower bound."""
    rt = F.col("rt_ms")
    cell = (rt - F.pmod(rt, F.lit(cell_ms))).cast("bigint")
    return (
        log.where(rt.isNotNull())
        .groupBy(*keys, cell.alias("cell_ms"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def rt_series(
    log: DataFrame,
    max_points: int = MAX_POINTS,
    run: str = "run_id",
    series: Sequence[str] = ("name",),
) -> DataFrame:
    """Requests over each run, its span cut into at most ``max_points`` equal steps.

    Requests are counted per start time first. The bounds of a run are joined to these counts
    by time block, so that a hot run is spread over many tasks.
    """
    counts = (
        log.where(F.col("start_ms").isNotNull())
        .groupBy(run, *series, "start_ms")
        .agg(F.count(F.lit(1)).alias("__n"), _count_if(_failed()).alias("__ko"))
        # Always true. With it the bounds need the same columns as the join, so Spark scans the
        # log and shuffles the counts once for both.
        .where(F.col("__ko") <= F.col("__n"))
    )
    placed = attach_over(
        counts,
        [run],
        F.shiftright("start_ms", BLOCK_BITS),
        __first=(F.min, "start_ms"),
        __last=(F.max, "start_ms"),
    )
    point = F.expr(f"(start_ms - __first) * {int(max_points)} div (__last - __first + 1)")
    return placed.groupBy(run, *series, point.alias("point")).agg(
        F.sum("__n").alias("requests"), F.sum("__ko").alias("failed")
    )


def slo_check(
    log: DataFrame,
    max_ms: int = GOAL_MAX_MS,
    percent: float = GOAL_PERCENT,
    keys: Sequence[str] = ("run_id",),
) -> DataFrame:
    """Whether every response stayed under ``max_ms`` and more than ``percent`` succeeded."""
    return (
        log.groupBy(*keys)
        .agg(F.max("rt_ms").alias("max_ms"), _percent_ok().alias("percent_ok"))
        .withColumn("max_met", F.col("max_ms") < max_ms)
        .withColumn("percent_met", F.col("percent_ok") > percent)
    )


def scenario_spans(
    log: DataFrame, keys: Sequence[str] = ("run_id", "scenario", "user_id")
) -> DataFrame:
    """First start, last end and length of each user's part in a scenario.

    While any request of the user is open, so is the part: its end and length are null.
    """
    still_open = _count_if(F.col("start_ms").isNotNull() & F.col("end_ms").isNull())
    return (
        log.groupBy(*keys)
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.when(still_open == 0, F.max("end_ms")).alias("end_ms"),
        )
        .withColumn("length_ms", F.col("end_ms") - F.col("start_ms"))
    )


def group_durations(groups: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Passes through each group, their mean and longest duration, and the failed ones."""
    duration = F.col("exit_ms") - F.col("entry_ms")
    return groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("passes"),
        whole_mean(duration).alias("mean_ms"),
        F.max(duration).alias("max_ms"),
        _count_if(_failed()).alias("failed"),
    )
