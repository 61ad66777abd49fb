"""The peak of open requests while the log still grows, and after it has grown for long.

A stream adds what each batch of records changes at each instant to that batch's own folder, so a
batch run again replaces itself and nothing is held as state. Time that is over is folded: a
stretch is fully told by its net change and its highest point, so a settled block is one row per run.
Reading folds stretches and instants into the peak of each run.

A record that comes after its time was settled is not lost: its changes count from the end of the
settled stretch on, which keeps all later levels right, and they are counted as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfield.operators.running import BLOCK_BITS, fold_peaks
from tallyfield.operators.sweep import LEVELS, open_changes

# A row covers the instants from at_ms to last_ms; an instant that is not settled covers itself.
STRETCHES = "run_id STRING, at_ms BIGINT, last_ms BIGINT, net BIGINT, peak BIGINT, settled BOOLEAN"
_BATCH = "batch"


def add_changes(log: DataFrame, path: str, batch: str) -> None:
    """Keep what a batch of records changes, under the batch's name."""
    changes = open_changes(log).select(
        "run_id", "at_ms", F.col("at_ms").alias("last_ms"), F.col("change").alias("net"),
        F.col("change").alias("peak"), F.lit(False).alias("settled"),
    )
    changes.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch}")


def stream_changes(log: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep what each batch of a stream of records changes.

    With no ``every`` the stream reads what is there and stops.
    """
    stream = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: add_changes(rows, path, str(batch))
    )
    return stream.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def _stretches(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """Settled stretches and instants in order, each once, with the number of late changes in it.

    A late instant goes to the end of the stretch that covers it. Stretches are whole blocks of
    2**bits instants, so the block finds the stretch.
    """
    rows = spark.read.schema(f"{STRETCHES}, {_BATCH} STRING").parquet(path).withColumn(
        "__block", F.shiftright("at_ms", bits)
    )
    stretches = rows.where("settled")
    over = stretches.select(F.col("run_id").alias("__run"), F.col("__block").alias("__over"), F.col("last_ms").alias("__end"))
    placed = (
        rows.where("NOT settled")
        .groupBy("run_id", "__block", "at_ms").agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("__rows"))
        .join(over, F.col("run_id").eqNullSafe(F.col("__run")) & (F.col("__block") == F.col("__over")), "left")
    )
    late = F.col("__end").isNotNull()
    instants = placed.select(
        "run_id", "__block", "at_ms", F.when(late, F.col("__rows")).otherwise(0).alias("late"),
        F.struct(late.alias("after"), F.when(late, 0).otherwise(F.col("at_ms")).alias("place")).alias("__o"), "net",
    )
    instants = instants.groupBy("run_id", "__block", "__o").agg(
        F.min("at_ms").alias("at_ms"), F.sum("net").alias("net"), F.sum("late").alias("late")
    )
    first = F.struct(F.lit(False).alias("after"), F.lit(0).cast("bigint").alias("place"))
    whole = stretches.select("run_id", "__block", first.alias("__o"), "at_ms", "net", F.lit(0).cast("bigint").alias("late"), "peak")
    return whole.unionByName(instants.withColumn("peak", F.col("net")))


def settle(spark: SparkSession, path: str, to: str, until_ms: int, bits: int = BLOCK_BITS) -> None:
    """Write what ``path`` holds to ``to``, with the blocks that end by ``until_ms`` as one row per run.

    ``to`` takes the place of ``path``: later batches are added there.
    """
    rows = spark.read.schema(f"{STRETCHES}, {_BATCH} STRING").parquet(path).drop(_BATCH)
    over = F.shiftright("at_ms", bits) < (until_ms >> bits)
    again = rows.where(over).withColumn("__block", F.shiftright("at_ms", bits))
    merged = again.where("NOT settled").groupBy("run_id", "__block", "at_ms").agg(F.sum("net").alias("net"))
    old = again.where("settled")
    # A block that is settled already stays as it is, and what came late stays beside it.
    known = old.select(F.col("run_id").alias("__run"), F.col("__block").alias("__over"))
    match = F.col("run_id").eqNullSafe(F.col("__run")) & (F.col("__block") == F.col("__over"))
    new = fold_peaks(merged.join(known, match, "left_anti"), ["run_id", "__block"], "at_ms", "net", levels=0)
    folded = new.select(
        "run_id", F.col("first_at").alias("at_ms"), (F.shiftleft(F.col("__block") + 1, bits) - 1).alias("last_ms"),
        "net", "peak", F.lit(True).alias("settled"),
    )
    late = merged.join(known, match, "left_semi").select(
        "run_id", "at_ms", F.col("at_ms").alias("last_ms"), "net", F.col("net").alias("peak"), F.lit(False).alias("settled")
    )
    kept = rows.where(~over).unionByName(old.drop("__block")).unionByName(folded).unionByName(late)
    kept.write.mode("overwrite").parquet(f"{to}/{_BATCH}=settled")


def read_peaks(spark: SparkSession, path: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Per run: max_open, the peak so far, open_now, what is open after the last change, and late changes."""
    parts = _stretches(spark, path, bits)
    # In a block: its stretch, or its instants, then what came late.
    blocks = fold_peaks(parts, ["run_id", "__block"], "__o", "net", ["late"], peak="peak", levels=0)
    done = fold_peaks(blocks, ["run_id"], "__block", "net", ["late"], peak="peak", levels=LEVELS)
    return done.select(
        "run_id", F.greatest("peak", F.lit(0)).cast("bigint").alias("max_open"),
        F.col("net").cast("bigint").alias("open_now"), F.col("late").cast("bigint").alias("late"),
    )
