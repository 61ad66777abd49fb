"""Response times as sketches that merge: percentiles of many runs without their requests.

A sketch keeps all times while a key has at most ``size`` of them, and a sample of bounded size,
weighted by rank, beyond that. Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.means import whole_sum
from tallyfield.operators.reqlog import KO, OK, PERCENTS, percent_name

# 16 to 40 KB a sketch.
SKETCH_SIZE = 4096

SKETCHED = (
    "run_id STRING, name STRING, requests BIGINT, ok BIGINT, ko BIGINT, timed BIGINT, min_ms BIGINT, "
    "max_ms BIGINT, sum_ms DECIMAL(38,0), sketch BINARY"
)


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far, as a share of all times, the rank of a percentile may be off, in 99 of 100 sketches.

    The published bound of the sketch; 0.07 % at the default size.
    """
    return 2.296 / size**0.9723


def rt_sketches(
    log: DataFrame, keys: Sequence[str] = ("run_id", "name"), size: int = SKETCH_SIZE
) -> DataFrame:
    """Per key: counts, least and largest time, their sum, and a sketch, null where no request is timed."""
    timed = F.count("rt_ms")
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(F.col("status") == OK, 1)).alias("ok"),
        F.count(F.when(F.col("status") == KO, 1)).alias("ko"),
        timed.alias("timed"),
        F.min("rt_ms").alias("min_ms"),
        F.max("rt_ms").alias("max_ms"),
        whole_sum("rt_ms").cast("decimal(38,0)").alias("sum_ms"),
        F.when(timed > 0, F.kll_sketch_agg_bigint("rt_ms", F.lit(size))).alias("sketch"),
    )


def merge_sketches(
    sketched: DataFrame,
    percents: Sequence[float] = PERCENTS,
    keys: Sequence[str] = ("name",),
    size: int = SKETCH_SIZE,
) -> DataFrame:
    """Statistics and percentiles per key over any number of sketched rows.

    A percentile is the least time that at least that share of all times does not exceed: exact up
    to ``size`` times of a key, and within ``rank_error(size)`` in rank beyond. All else is exact.
    """
    merged = sketched.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("requests", "ok", "ko", "timed")],
        F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"),
        F.sum("sum_ms").alias("__sum"),
        F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("__sketch"),
    )
    held = F.when(F.col("timed") > 0, F.col("__sketch"))
    return merged.select(
        *keys,
        "requests",
        "ok",
        "ko",
        "min_ms",
        "max_ms",
        F.try_divide(F.col("__sum").cast("double"), F.col("timed")).alias("mean_ms"),
        *[
            F.kll_sketch_get_quantile_bigint(held, F.lit(p / 100.0)).alias(percent_name(p))
            for p in percents
        ],
    )
