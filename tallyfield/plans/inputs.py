"""The given tables seen as exposure, loss, log, session and reply tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.decoding import TABLE_KIND, TEXT_KIND
from tallyfield.sources.features import load_feature

EXPOSURE_COLUMNS = {
    "portfolio_id": "l_suppkey",
    "site_id": "l_partkey",
    "cov1val": "l_quantity",
    "cov2val": "l_extendedprice",
    "cov3val": "l_discount",
    "cov4val": "l_tax",
}
LOSS_COLUMNS = {"site_id": "p_partkey", "loss": "p_retailprice"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_feature(spark, f"{sf_dir}/lineitem.parquet", columns=EXPOSURE_COLUMNS)


def loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_feature(spark, f"{sf_dir}/part.parquet", columns=LOSS_COLUMNS)


def as_request_log(events: DataFrame) -> DataFrame:
    """Events, static or streamed, as request records: one run per day, errors as failures."""
    failed = F.col("event_type") == "error"
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    took = F.floor(F.col("value") * 10).cast("bigint")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("date").cast("string").alias("run_id"),
        F.lit("main").alias("scenario"),
        "user_id",
        F.col("event_type").alias("name"),
        start.alias("start_ms"),
        (start + took).alias("end_ms"),
        F.when(failed, "KO").otherwise("OK").alias("status"),
        F.when(failed, F.col("props")).alias("message"),
        took.alias("rt_ms"),
        (start + F.shiftright(took, 2)).alias("request_end_ms"),
        (start + F.shiftright(took, 1)).alias("response_start_ms"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_request_log(table(spark, sf_dir, "events"))


def as_overlapping_log(events: DataFrame) -> DataFrame:
    """The request log with response times in seconds, so that requests overlap.

    Every tenth request has no end yet.
    """
    end = F.col("start_ms") + F.col("rt_ms") * 1000
    return as_request_log(events).withColumn("end_ms", F.when(F.col("id") % 10 != 0, end))


def overlapping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_overlapping_log(table(spark, sf_dir, "events"))


def log_with_total_name(events: DataFrame) -> DataFrame:
    """The request log in which purchases are named as the rows over all names are."""
    name = F.when(F.col("name") == "purchase", "all").otherwise(F.col("name"))
    return as_request_log(events).withColumn("name", name)


def group_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass per run, user and request name."""
    any_failed = F.count(F.when(F.col("status") == "KO", 1)) > 0
    return (
        request_log(spark, sf_dir)
        .groupBy("run_id", "scenario", "user_id", "name")
        .agg(
            F.min("start_ms").alias("entry_ms"),
            F.max("end_ms").alias("exit_ms"),
            F.when(any_failed, "KO").otherwise("OK").alias("status"),
        )
    )


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log(spark, sf_dir).select(
        F.col("user_id").alias("session_id"),
        (F.col("start_ms") * 1_000_000).alias("start_ns"),
        (F.col("end_ms") * 1_000_000).alias("end_ns"),
    )


def session_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events say of the session of their user: it starts, runs, or dies."""
    kind = F.col("name")
    state = F.when(kind == "signup", "Starting").when(kind == "purchase", "RUNNING").when(kind == "error", "dead")
    return request_log(spark, sf_dir).where(state.isNotNull()).select(
        F.col("user_id").alias("session_id"),
        (F.col("start_ms") * 1_000_000).alias("changed_ns"),
        F.col("id").alias("change_id"),
        state.alias("state"),
    )


def stated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and errors as statements, the latter at the very instant of their change."""
    log = request_log(spark, sf_dir).where(F.col("name").isin("view", "click", "error"))
    return log.select(
        F.col("id").alias("statement_id"),
        F.col("user_id").alias("session_id"),
        (F.col("start_ms") * 1_000_000).alias("start_ns"),
        (F.col("end_ms") * 1_000_000).alias("end_ns"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, listed by order key, grouped by customer."""
    status = F.col("o_orderstatus")
    state = F.when(status == "F", "Idle").when(status == "O", "STARTING").otherwise("dead")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cluster"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("position"),
        state.alias("state"),
    )


def _json(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def statement_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON replies of every kind: table, text, neither, error, pending, unreadable."""
    kind, value, number = F.col("event_type"), F.col("value"), F.col("event_id")
    step = F.regexp_extract("props", r"(\d+)", 1)
    done = ('{"id":', number, ',"state":"available","output":')
    ok = (*done, '{"status":"ok","execution_count":1,"data":')
    text = f'"{TEXT_KIND}":"user '
    reply = (
        F.when(
            kind == "error",
            _json(
                *done,
                '{"status":"error","ename":"StepError","evalue":"step ',
                step,
                '","stackTrace":["at step ',
                step,
                '","for user ',
                F.col("user_id"),
                '"]}}',
            ),
        )
        .when(
            kind == "view",
            _json(*ok, "{", text, F.col("user_id"), f'","{TABLE_KIND}":{{"step":', step, "}}}}"),
        )
        .when(kind == "click", _json(*ok, "{", text, F.col("user_id"), '"}}}'))
        .when(kind == "purchase", _json(*ok, "{}}}"))
        .when(value < 5, _json('{"id":', number, ',"state":"running","progress":0.5}'))
        .when(value < 10, _json(*done, '{"status":"odd"}}'))
        .when(value < 20, _json(*done, '{"data":{}}}'))
        .otherwise(_json('{"id":', number, ',"state":"avail'))
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


def _session_json() -> Column:
    """An order as a JSON session snapshot; a finished one has no application."""
    status = F.col("o_orderstatus")
    app = F.when(
        status != "P",
        _json(
            '"appId":"app_',
            F.col("o_custkey"),
            '","appInfo":{"driverLogUrl":null,"sparkUiUrl":"/ui/',
            F.col("o_custkey"),
            '"},',
        ),
    ).otherwise("")
    return _json(
        '{"id":',
        F.col("o_orderkey"),
        ',"kind":"spark",',
        app,
        '"state":"',
        F.when(status == "F", "idle").when(status == "O", "starting").otherwise("dead"),
        '","log":["stdout: ","',
        F.col("o_orderpriority"),
        '"]}',
    )


def session_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", _session_json().alias("reply"))


def session_list_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a list of two sessions: itself and a running one of its customer."""
    running = _json('{"id":', F.col("o_custkey"), ',"state":"running"}')
    listing = _json('{"from":0,"total":2,"sessions":[', _session_json(), ",", running, "]}")
    return table(spark, sf_dir, "orders").select("o_orderkey", listing.alias("reply"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as text, some of them spoilt."""
    day = F.col("o_orderdate").cast("date").cast("string")
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "2-HIGH", F.concat(F.substring(day, 1, 5), F.lit("13-45")))
        .when(priority == "3-MEDIUM", F.concat(day, F.lit("abc")))
        .when(priority == "4-NOT SPECIFIED", "")
        .otherwise(day)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
