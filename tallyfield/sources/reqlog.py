"""Load-test records as partitioned Parquet, one folder per run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of the load-test records.
REQUEST_SCHEMA = (
    "id BIGINT, run_id STRING, scenario STRING, user_id BIGINT, name STRING, start_ms BIGINT, "
    "end_ms BIGINT, status STRING, message STRING, rt_ms BIGINT, request_end_ms BIGINT, "
    "response_start_ms BIGINT"
)
RUN_SCHEMA = "run_id STRING, run_date TIMESTAMP, simulation_id STRING, description STRING"
SCENARIO_SCHEMA = (
    "run_id STRING, scenario STRING, user_id BIGINT, event STRING, start_ms BIGINT, end_ms BIGINT"
)
GROUP_SCHEMA = (
    "run_id STRING, scenario STRING, user_id BIGINT, name STRING, entry_ms BIGINT, "
    "exit_ms BIGINT, status STRING"
)


def write_reqlog(
    log: DataFrame,
    path: str,
    replace_runs: bool = False,
    schema: str = REQUEST_SCHEMA,
    order: Sequence[str] = (),
    lookups: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Append records of any of the kinds above under one folder per run.

    What reading would not give back is refused: columns that ``schema`` does not name, and an
    empty run id, which as a folder is the same as none.

    The rebalance gathers each run into few files, and adaptive execution splits a run too
    large for one task. With ``replace_runs`` the runs in ``log`` take the place of what is
    there, so that a job started over does not add its records twice.

    ``order`` sorts the records of a file, such as by start_ms, so that a range of it is in few row groups;
    ``lookups`` are columns that single values are looked up in, such as user_id: each row group
    gets a Bloom filter of them, and groups without the value are skipped. ``options`` go to the writer.
    """
    unnamed = set(log.columns) - set(StructType.fromDDL(schema).names)
    if unnamed:
        raise ValueError(f"columns that the schema does not name: {', '.join(sorted(unnamed))}")
    run = F.col("run_id")
    refused = F.raise_error(F.lit("run_id must not be empty")).cast("string")
    log = log.withColumn("run_id", F.when(run == "", refused).otherwise(run))
    dealt = log.hint("rebalance", "run_id")
    if order:
        dealt = dealt.sortWithinPartitions("run_id", *order)
    writer = dealt.write.partitionBy("run_id").options(**(options or {}))
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if replace_runs:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def read_reqlog(spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA) -> DataFrame:
    """Read records. A filter on run_id skips the folders of other runs."""
    return spark.read.schema(schema).parquet(path)


def stream_reqlog(
    spark: SparkSession, path: str, schema: str = REQUEST_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Records as a stream that follows the folder; a batch takes all new files by default."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
