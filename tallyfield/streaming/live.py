"""Live load-test metrics from a stream of request records."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.functions.means import whole_mean
from tallyfield.operators.reqlog import ALL, KO, percent_name
from tallyfield.session import analysis_session

LABELS = ("name", "is_all")
METRICS = ("requests", "failed", "max_ms", "mean_ms")
_BATCH = "batch"

# State on executor disks, not in their memory; the checkpoint gets what changed. A batch
# without data would only drop old state, which the next batch with data does as well.
UPDATE_OPTIONS = {
    "stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "noDataMicroBatches.enabled": "false",
}


def update_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster for streams that end in ``update_metrics``."""
    session = analysis_session(spark)
    for key, value in UPDATE_OPTIONS.items():
        session.conf.set(f"spark.sql.streaming.{key}", value)
    return session


def live_metrics(
    log: DataFrame,
    interval: str = "1 second",
    delay: str = "1 minute",
    at: str = "start_ms",
    percents: Sequence[float] = (),
    totals_only: bool = False,
    accuracy: int = 10_000,
    once: Sequence[str] = (),
) -> DataFrame:
    """Per interval, request name and over all names: count, failures, longest and mean time.

    ``is_all`` marks the rows over all names, since a request may be named as they are. Each of
    ``percents`` adds a percentile of the response time, off a sketch of bounded size whose
    rank error is 1 / ``accuracy``. ``totals_only`` leaves out the rows per name.

    ``once`` names the columns that tell a record, such as run_id and id: a record sent again counts
    once. On a stream its copies must come within ``delay`` of each other, which bounds the ids held,
    and the stream must end in ``append_metrics``; ``late_rows`` tells how many rows came too late.

    Works on a stream and on a static log. On a stream, rows more than ``delay`` behind the
    newest one may be dropped; the watermark also bounds the state.
    """
    total = F.struct(F.lit(ALL).alias("name"), F.lit(True).alias("is_all"))
    named = F.struct(F.col("__name").alias("name"), F.lit(False).alias("is_all"))
    labels = F.array(total) if totals_only else F.array(named, total)
    records = log.select(
        F.timestamp_millis(at).alias("__at"), "status", "rt_ms", F.col("name").alias("__name"),
        *[F.col(c).alias(f"__once{i}") for i, c in enumerate(once)],
    ).withWatermark("__at", delay)
    told = [f"__once{i}" for i in range(len(once))]
    if told:
        records = records.dropDuplicatesWithinWatermark(told) if log.isStreaming else records.dropDuplicates(told)
    copies = records.select("__at", "status", "rt_ms", F.inline(labels))
    sketched = [
        F.percentile_approx("rt_ms", p / 100.0, accuracy).cast("double").alias(percent_name(p))
        for p in percents
    ]
    return (
        copies.groupBy(F.window("__at", interval).alias("__window"), *LABELS)
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count(F.when(F.col("status") == KO, 1)).alias("failed"),
            F.max("rt_ms").alias("max_ms"),
            whole_mean("rt_ms").alias("mean_ms"),
            *sketched,
        )
        .select(
            F.unix_millis("__window.start").alias("window_ms"),
            *LABELS,
            *METRICS,
            *map(percent_name, percents),
        )
    )


def append_metrics(
    metrics: DataFrame, path: str, checkpoint: str, every: str | None = "1 second"
) -> StreamingQuery:
    """Write each interval to Parquet once, when the watermark has passed its end.

    With no ``every``, the stream reads what is there and stops; the intervals of the last
    ``delay`` of the log stay open and are written when it goes on.
    """
    stream = (
        metrics.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.trigger(**trigger).start()


def late_rows(stream: StreamingQuery) -> int:
    """Rows that the stream dropped as they came behind the watermark, as far back as its progress reaches.

    The session keeps ``spark.sql.streaming.numRecentProgressUpdates`` batches, 100 by default.
    """
    return sum(
        int(operator["numRowsDroppedByWatermark"])
        for progress in stream.recentProgress
        for operator in json.loads(progress.json)["stateOperators"]
    )


def update_metrics(
    metrics: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the intervals that each batch changed to that batch's folder under ``path``.

    A batch run again after a failure overwrites its own folder. With no ``every``, the
    stream reads what is there and stops. A stream that runs for long should rather use
    ``append_metrics``, which writes each interval once.
    """

    def write_batch(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch}")

    stream = (
        metrics.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
    )
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.trigger(**trigger).start()


def read_updates(spark: SparkSession, path: str, percents: Sequence[float] = ()) -> DataFrame:
    """The newest metrics of each interval and name from the folders of ``update_metrics``.

    ``percents`` are those that ``live_metrics`` was given.
    """
    names = [percent_name(p) for p in percents]
    schema = (
        "window_ms BIGINT, name STRING, is_all BOOLEAN, requests BIGINT, failed BIGINT, "
        f"max_ms BIGINT, mean_ms DOUBLE, {''.join(f'{n} DOUBLE, ' for n in names)}{_BATCH} BIGINT"
    )
    updates = spark.read.schema(schema).parquet(path)
    newest = [F.max_by(metric, _BATCH).alias(metric) for metric in (*METRICS, *names)]
    return updates.groupBy("window_ms", *LABELS).agg(*newest)
