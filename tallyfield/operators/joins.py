"""Joins of registered views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def join_views(
    session: SparkSession, left: str, right: str, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join of two views of an ``analysis_session``.

    No side is forced: the session's broadcast limit decides, and beyond it Spark sort-merges
    and adaptive execution splits hot keys.
    """
    return session.table(left).join(session.table(right), on, how)


def save_bucketed(df: DataFrame, name: str, path: str, on: str | Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` as a table of the session's catalog, dealt by hash of ``on`` into sorted buckets.

    Each bucket is one file, so that reading keeps its order. A bucket should fit into an
    executor's memory a few times over: some hundred MB.
    """
    keys = [on] if isinstance(on, str) else list(on)
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def join_colocated(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join by merging. Tables of ``save_bucketed`` with the same keys and number of buckets are not
    shuffled again; any other side is shuffled, and sorted, for itself."""
    return left.join(right.hint("merge"), on, how)


def attach_totals(df: DataFrame, other: DataFrame, **totals: Column) -> DataFrame:
    """Every row of ``df`` beside one row of totals over all of ``other``.

    This is the product of two tables of which one has a single row. Each total is a scalar
    subquery, so there is no Cartesian join and the broadcast is one value.
    """
    return df.select(
        "*", *[other.agg(total.alias(name)).scalar().alias(name) for name, total in totals.items()]
    )


def attach_over(
    rows: DataFrame, keys: Sequence[str], spread: Column, **over: tuple[Callable, str]
) -> DataFrame:
    """Every row beside sums, minima or maxima over all rows with its ``keys``.

    ``over`` maps an output name to (``F.sum``, ``F.min`` or ``F.max``, column). The rows of a
    key are told apart by ``spread``: values are reduced per (keys, spread), combined over the
    few spreads of a key, and joined back per (keys, spread), so a hot key is many small joins.
    """
    spread_keys = [*keys, "__spread"]
    parts = rows.withColumn("__spread", spread)
    reduced = parts.groupBy(*spread_keys).agg(*[f(c).alias(n) for n, (f, c) in over.items()])
    whole = Window.partitionBy(*keys)
    combined = reduced.select(
        *[F.col(k).alias(f"__r_{k}") for k in spread_keys],
        *[f(n).over(whole).alias(n) for n, (f, _) in over.items()],
    )
    # A null key is a key like any other.
    match = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in spread_keys]
    return parts.join(combined, match).drop("__spread", *[f"__r_{k}" for k in spread_keys])
