"""Exact running totals and peaks over ordered rows, with no large partition.

A window with few or no keys would bring a hot key's whole history into one task. Here the
ordering value is cut into blocks of 2**bits, rows are totalled per block, and each block
opens with what the blocks before it add up to. Once rows are unique per (keys, at), a task
holds at most 2**bits rows of a block and the level above holds one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# 2**21 milliseconds are about 35 minutes, so a century of them is about 1.5 million blocks.
BLOCK_BITS = 21


def running_total(
    cells: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    total: str | None = None,
    bits: int = BLOCK_BITS,
    levels: int = 1,
) -> DataFrame:
    """``cells`` with ``out``: the sum of ``value`` per key over rows up to and including ``at``.

    ``at`` is a bigint. ``total`` names an optional column with the sum over the whole key.
    ``levels`` is how often blocks are cut; two suit values spread over the full bigint range.
    """
    if levels == 0:
        whole = Window.partitionBy(*keys)
        upto = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        done = cells.withColumn(out, F.sum(value).over(upto))
        return done if total is None else done.withColumn(total, F.sum(value).over(whole))

    block, net, before, opener = (f"__{n}{levels}" for n in ("block", "net", "upto", "opener"))
    rows = cells.withColumn(block, F.shiftright(at, bits))
    nets = rows.groupBy(*keys, block).agg(F.sum(value).alias(net))
    carried = running_total(nets, keys, block, net, before, total, bits, levels - 1)
    # One extra row opens each block with the sum carried into it; a union needs no join, so
    # null keys need no care and both sides meet in the window's own shuffle.
    openers = carried.select(
        *keys,
        block,
        (F.col(before) - F.col(net)).alias(value),
        *([total] if total else []),
        F.lit(True).alias(opener),
    )
    both = rows.withColumn(opener, F.lit(False)).unionByName(openers, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(F.desc(opener), at)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    done = both.withColumn(out, F.sum(value).over(inside))
    if total:
        done = done.withColumn(total, F.first(total, ignorenulls=True).over(inside))
    return done.where(~F.col(opener)).select(*cells.columns, out, *([total] if total else []))


def fold_peaks(
    cells: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    sums: Sequence[str] = (),
    bits: int = BLOCK_BITS,
    levels: int = 1,
    peak: str | None = None,
) -> DataFrame:
    """Per key: ``net``, the whole change, ``peak``, the largest running sum, and ``first_at``.

    A stretch of rows is fully told by its net change and its highest point, so blocks fold
    into larger blocks and no row is joined back. ``sums`` are columns that are added up. Cells
    that are stretches themselves bring their highest point in ``peak``.
    """
    part = cells.select(
        *keys,
        F.col(at).alias("__at"),
        F.col(value).alias("net"),
        F.col(peak or value).alias("peak"),
        F.col(at).alias("first_at"),
        *sums,
    )
    for level in range(levels + 1):
        last = level == levels
        group = list(keys) if last else [*keys, "__block"]
        if not last:
            part = part.withColumn("__block", F.shiftright("__at", bits))
        earlier = (
            Window.partitionBy(*group)
            .orderBy("__at")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        reached = F.coalesce(F.sum("net").over(earlier), F.lit(0)) + F.col("peak")
        part = (
            part.withColumn("__reached", reached)
            .groupBy(*group)
            .agg(
                F.sum("net").alias("net"),
                F.max("__reached").alias("peak"),
                F.min("first_at").alias("first_at"),
                *[F.sum(s).alias(s) for s in sums],
            )
        )
        if not last:
            part = part.withColumnRenamed("__block", "__at")
    return part


def running_peak(
    cells: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    bits: int = BLOCK_BITS,
    levels: int = 1,
) -> DataFrame:
    """Per key, the largest running sum of ``value`` in ``at`` order; one row per key."""
    folded = fold_peaks(cells, keys, at, value, bits=bits, levels=levels)
    return folded.select(*keys, F.coalesce("peak", F.lit(0)).cast("bigint").alias(out))
