"""Statement replies and statement times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.decoding import (
    listed_sessions,
    session_fields,
    statement_fields,
    statement_outcome,
    statement_text,
)
from tallyfield.functions.matching import full_match
from tallyfield.functions.means import whole_mean
from tallyfield.operators.asof import asof_join
from tallyfield.operators.sessions import is_active

# Fixed value: the time limit of a statement.
STATEMENT_LIMIT_MS = 120_000


def decode_statements(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replaces the JSON column by statement_id, state, outcome, text, ename, evalue, trace."""
    kept = [c for c in replies.columns if c != reply]
    output = F.col("output")
    succeeded, failed = F.col("outcome") == "ok", F.col("outcome") == "error"
    return (
        replies.select(*kept, statement_fields(F.col(reply)).alias("statement_id", "state", "output"))
        .withColumn("outcome", statement_outcome(F.col("statement_id"), F.col("state"), output))
        .select(
            *kept,
            "statement_id",
            "state",
            "outcome",
            F.when(succeeded, statement_text(output)).alias("text"),
            F.when(failed, output["ename"]).alias("ename"),
            F.when(failed, output["evalue"]).alias("evalue"),
            F.when(failed, output["stackTrace"]).alias("trace"),
        )
    )


def _snapshot(session: str) -> list[Column]:
    fields = {
        "session_id": "id",
        "app_id": "appId",
        "state": "state",
        "driver_log_url": "appInfo.driverLogUrl",
        "spark_ui_url": "appInfo.sparkUiUrl",
        "log": "log",
    }
    return [F.col(f"{session}{field}").alias(name) for name, field in fields.items()]


def decode_sessions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replaces the JSON column by the columns of a session snapshot."""
    kept = [c for c in replies.columns if c != reply]
    return replies.select(*kept, session_fields(F.col(reply))).select(*kept, *_snapshot(""))


def decode_session_lists(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per session of each JSON session list, with its place in the list from 0."""
    kept = [c for c in replies.columns if c != reply]
    listed = replies.select(*kept, listed_sessions(F.col(reply)).alias("position", "__session"))
    return listed.select(*kept, "position", *_snapshot("__session."))


def result_match(decoded: DataFrame, pattern: str) -> DataFrame:
    """The successful statements whose whole text matches the pattern."""
    return decoded.where((F.col("outcome") == "ok") & full_match(F.col("text"), pattern))


def error_match(
    decoded: DataFrame,
    ename: str | None = None,
    evalue: str | None = None,
    trace: str | None = None,
) -> DataFrame:
    """The failed statements that match every given pattern; a missing trace is empty text."""
    lines = F.array_join(F.coalesce(F.col("trace"), F.array().cast("array<string>")), "\n")
    wanted = [(F.col("ename"), ename), (F.col("evalue"), evalue), (lines, trace)]
    kept = decoded.where(F.col("outcome") == "error")
    for text, pattern in wanted:
        if pattern is not None:
            kept = kept.where(full_match(text, pattern))
    return kept


def statement_times(log: DataFrame) -> DataFrame:
    """Count, mean and longest statement time in seconds per session."""
    taken = F.col("end_ns") - F.col("start_ns")
    return log.groupBy("session_id").agg(
        F.count(taken).alias("statements"),
        (whole_mean(taken) / 1e9).alias("mean_s"),
        (F.max(taken) / 1e9).alias("max_s"),
    )


def slow_statements(log: DataFrame, limit_ms: int = STATEMENT_LIMIT_MS) -> DataFrame:
    """Statements per session that took longer than the limit; 0 where none did."""
    taken = F.col("end_ns") - F.col("start_ns")
    over = F.count(F.when(taken > limit_ms * 1_000_000, 1))
    return log.groupBy("session_id").agg(over.alias("over_limit"))


def session_at_start(log: DataFrame, changes: DataFrame, order: str = "change_id") -> DataFrame:
    """Each statement with the state its session had when it started, since when, and whether in use.

    ``changes`` has session_id, changed_ns and state. A statement before the first change of its
    session has no state and is not in use.
    """
    found = asof_join(
        log, changes, ["session_id"], "start_ns", "changed_ns", ["state"], order, since="state_since_ns"
    )
    return found.withColumn("active", F.coalesce(is_active("state"), F.lit(False)))


def statement_times_by_state(stated: DataFrame) -> DataFrame:
    """Count, mean and longest statement time in seconds per state at the start."""
    taken = F.col("end_ns") - F.col("start_ns")
    return stated.groupBy("state", "active").agg(
        F.count(taken).alias("statements"),
        (whole_mean(taken) / 1e9).alias("mean_s"),
        (F.max(taken) / 1e9).alias("max_s"),
    )
