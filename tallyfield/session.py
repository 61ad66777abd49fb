"""Session options and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyfield.functions.exposure import register_functions

# Fixed value: the size up to which the analysis session lets Spark broadcast a join side.
BROADCAST_LIMIT = 200 * 1024 * 1024

# How many times larger than its compressed files a table is taken to be in memory.
COMPRESSION_FACTOR = 4.0


def analysis_session(
    spark: SparkSession,
    broadcast_limit: int = BROADCAST_LIMIT,
    compression_factor: float = COMPRESSION_FACTOR,
) -> SparkSession:
    """A session on the same cluster with the caller's settings, the analysis options and SQL functions.

    Options, views and functions set here stay out of the caller's session. Spark compares
    its size estimate of each join side with ``broadcast_limit``, and with adaptive execution
    the size measured after a shuffle; a larger side is joined by sort-merge. The estimate of
    a table is the size of its files times ``compression_factor``.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.sources.fileCompressionFactor", str(compression_factor))
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", str(broadcast_limit))
    register_functions(session)
    return session


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyfield-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Run ``df`` once into the shared folder and read it back, so that its size is known.

    ``compression`` is a Parquet codec, Spark's setting if it is not given.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
