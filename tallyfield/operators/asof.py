"""What held at an instant: each row beside the latest change at or before it.

A window over a key would bring a hot key's whole history into one task, and a join on ranges
would compare its rows with all its changes. Here rows and changes meet once per (key, instant);
instants are cut into blocks, and each block opens with the last value of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.operators.running import BLOCK_BITS

LEVELS = 2


def _at_or_before(keys: Sequence[str], at: str, before: bool, opener: str | None = None):
    order = [at] if opener is None else [F.desc(opener), at]
    end = -1 if before else Window.currentRow
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def running_last(
    cells: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    out: str,
    before: bool = False,
    bits: int = BLOCK_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """``cells`` with ``out``: the last ``value`` that is not null, per key, up to each ``at``.

    Cells are unique per (keys, at); ``at`` is a bigint. With ``before`` the row's own value does
    not count. A task holds at most 2**bits cells of a block, and one row per block above that.
    """
    if levels == 0:
        window = _at_or_before(keys, at, before)
        return cells.withColumn(out, F.last(value, ignorenulls=True).over(window))

    block, carry, opener = (f"__{n}{levels}" for n in ("lastblock", "carry", "lastopener"))
    rows = cells.withColumn(block, F.shiftright(at, bits))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at)))
    ends = rows.groupBy(*keys, block).agg(newest.alias(value))
    carried = running_last(ends, keys, block, value, carry, True, bits, levels - 1)
    openers = carried.select(*keys, block, F.col(carry).alias(value), F.lit(True).alias(opener))
    both = rows.withColumn(opener, F.lit(False)).unionByName(openers, allowMissingColumns=True)
    inside = _at_or_before([*keys, block], at, before, opener)
    done = both.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    return done.where(~F.col(opener)).select(*cells.columns, out)


def asof_join(
    rows: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    changed_at: str,
    values: Sequence[str],
    order: str | None = None,
    since: str | None = None,
    bits: int = BLOCK_BITS,
    levels: int = LEVELS,
) -> DataFrame:
    """Every row with the ``values`` of the latest change of its ``keys`` at or before ``at``.

    Instants are bigints. Of changes at one instant the one with the largest ``order`` counts, and
    without an ``order`` the largest values do. A change without an instant never happened; a row
    without one, or with none before it, gets nulls. A null key is a key like any other, and a
    change may set a value to null. ``since`` names an optional column for the change's instant.
    """
    clash = {*values, *([since] if since else [])} & set(rows.columns)
    if clash:
        raise ValueError(f"columns that the rows have already: {', '.join(sorted(clash))}")
    kept = F.struct(*values, F.col(changed_at).cast("bigint").alias("__since"))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    # A change without a place in the order comes before those that have one.
    place = kept if order is None else F.struct(F.col(order).isNotNull(), F.col(order), kept)
    told = (
        changes.where(F.col(changed_at).isNotNull())
        .groupBy(*named, F.col(changed_at).cast("bigint").alias("__at"))
        .agg(F.max_by(kept, place).alias("__value"))
    )
    instants = rows.where(F.col(at).isNotNull()).select(*named, F.col(at).cast("bigint").alias("__at")).distinct()
    empty = F.lit(None).cast(told.schema["__value"].dataType)
    asked = F.max("__asked").alias("__asked")
    cells = (
        told.withColumn("__asked", F.lit(False))
        .unionByName(instants.withColumns({"__value": empty, "__asked": F.lit(True)}))
        .groupBy(*names, "__at")
        # The struct of a change is never null itself, so it is the only one to be found here.
        .agg(F.first("__value", ignorenulls=True).alias("__value"), asked)
    )
    found = running_last(cells, names, "__at", "__value", "__held", False, bits, levels).where("__asked")
    # One row per (key, instant): a hot key is many join keys, and adaptive execution splits a hot instant.
    match = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = rows.join(found.select(*names, "__at", "__held"), [*match, F.col(at).cast("bigint") == F.col("__at")], "left")
    out: list[Column] = [F.col(f"__held.`{v}`").alias(v) for v in values]
    if since:
        out.append(F.col("__held.__since").alias(since))
    return joined.select(*rows.columns, *out)
