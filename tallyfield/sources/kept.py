"""Aggregates that are kept, so that what is new is added without reading all that came before.

Each kept table is a folder of parts: one per run of a load test, or one per batch of feature
rows. A part written again takes its own place, so a job may be started over. What is read is the merge of
all parts. A part is whole once its job has ended; read before or after, not meanwhile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.functions.exposure import COVERAGES
from tallyfield.operators.exposure import SITE_KEYS, max_exposure
from tallyfield.operators.sketches import SKETCH_SIZE, SKETCHED, rt_sketches
from tallyfield.sources.reqlog import write_reqlog

_BATCH = "batch"


def keep_sketches(log: DataFrame, path: str, size: int = SKETCH_SIZE) -> None:
    """Reduce the runs in ``log`` to one row per (run, name) and let them take their place under ``path``.

    The runs must be whole: of a run, what ``log`` holds is all that will be kept.
    """
    write_reqlog(rt_sketches(log, size=size), path, replace_runs=True, schema=SKETCHED)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The kept rows of all runs; a filter on run_id skips the folders of the others."""
    return spark.read.schema(SKETCHED).parquet(path)


def _named(batch: str) -> str:
    if not batch or set(batch) & set("/\\=:"):
        raise ValueError(f"not a name for a batch: {batch!r}")
    return batch


def keep_maxima(
    exposure: DataFrame,
    path: str,
    batch: str,
    keys: Sequence[str] = SITE_KEYS,
    coverages: Sequence[str] = COVERAGES,
) -> None:
    """Reduce a batch of feature rows to its largest coverage sums and keep them under its name.

    Largest values stay right however often a row is counted, so a batch may overlap others and
    may come again, also after it went into a merged table.
    """
    max_exposure(exposure, keys, coverages).write.mode("overwrite").parquet(f"{path}/{_BATCH}={_named(batch)}")


def read_maxima(spark: SparkSession, path: str, keys: Sequence[str] = SITE_KEYS) -> DataFrame:
    """The largest coverage sum per key over all kept batches: the answer of ``max_exposure`` over all rows."""
    parts = spark.read.parquet(path)
    return parts.groupBy(*keys).agg(F.max("max_10").alias("max_10"))


def merge_maxima(spark: SparkSession, path: str, to: str, keys: Sequence[str] = SITE_KEYS) -> None:
    """Merge all batches of a kept table into the first one of a new table, which takes its place."""
    read_maxima(spark, path, keys).write.mode("overwrite").parquet(f"{to}/{_BATCH}=merged")


def stream_maxima(
    exposure: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
    keys: Sequence[str] = SITE_KEYS,
    coverages: Sequence[str] = COVERAGES,
) -> StreamingQuery:
    """Keep each batch of a stream of feature rows; a batch run again replaces itself. No state is held.

    With no ``every`` the stream reads what is there and stops.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        keep_maxima(rows, path, f"s{batch}", keys, coverages)

    stream = exposure.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep)
    return stream.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
