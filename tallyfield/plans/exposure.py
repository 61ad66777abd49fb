"""Exposure queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.exposure import coverage_sum, register_functions
from tallyfield.operators import exposure as ops
from tallyfield.operators.joins import attach_totals, join_colocated, join_views, save_bucketed
from tallyfield.plans import inputs
from tallyfield.session import analysis_session, scratch_path
from tallyfield.sources.features import EXPOSURE_VIEW, LOSS_VIEW, load_feature, register
from tallyfield.sources.kept import keep_maxima, merge_maxima, read_maxima
from tallyfield.sources.views import run_sql

# Bounds that spread the given tables over all bins.
LOW, HIGH, BINS = 1000, 90000, 99
BUCKETS = 16


def feature_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.exposure(spark, sf_dir)


def feature_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_feature(
        spark,
        f"{sf_dir}/events.parquet",
        "purchase",
        columns={"site_id": "user_id", "cov1val": "value"},
        feature_column="event_type",
    )


def view_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(inputs.exposure(spark, sf_dir), EXPOSURE_VIEW)
    return spark.table(EXPOSURE_VIEW).groupBy("portfolio_id").agg(F.count("*").alias("locations"))


def view_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposure, loss = inputs.exposure(spark, sf_dir), inputs.loss(spark, sf_dir)
    return ops.prepare_views(spark, exposure, loss, LOW, HIGH, BINS)


def sql_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = (
        "SELECT e.portfolio_id, max(e.cov2val) AS top_value, min(e.cov4val) AS low_value "
        f"FROM {EXPOSURE_VIEW} e WHERE e.cov1val >= 10 GROUP BY e.portfolio_id"
    )
    return run_sql(spark, sql, {EXPOSURE_VIEW: inputs.exposure(spark, sf_dir)})


def coverage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.exposure(spark, sf_dir).select(
        "portfolio_id", "site_id", coverage_sum().alias("total")
    )


def project_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.exposure(spark, sf_dir).select(
        F.col("cov2val").alias("value"),
        F.col("cov1val").alias("quantity"),
        F.col("portfolio_id").alias("portfolio"),
        F.col("site_id").alias("site"),
    )


def max_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_exposure(inputs.exposure(spark, sf_dir))


def exposure_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exposure_bins(inputs.exposure(spark, sf_dir), low=LOW, high=HIGH, count=BINS)


def exposure_bins_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines arrive in three batches; two are merged, one comes again, and the bins come from what is kept."""
    columns = {**inputs.EXPOSURE_COLUMNS, "line": "l_linenumber"}
    lines = load_feature(spark, f"{sf_dir}/lineitem.parquet", columns=columns)
    path, merged = scratch_path(spark, "maxima"), scratch_path(spark, "maxima")
    keep_maxima(lines.where("line <= 2"), path, "first")
    keep_maxima(lines.where("line BETWEEN 3 AND 4"), path, "second")
    merge_maxima(spark, path, merged)
    keep_maxima(lines.where("line > 4"), merged, "third")
    keep_maxima(lines.where("line BETWEEN 3 AND 4"), merged, "second")
    return ops.bin_maxima(read_maxima(spark, merged), low=LOW, high=HIGH, count=BINS)


def join_colocated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both features are saved in buckets of the site, then joined without a shuffle."""
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("-", 1)[1]
    exposure, loss = inputs.exposure(spark, sf_dir), inputs.loss(spark, sf_dir)
    left = save_bucketed(exposure, f"exposure_{name}", f"{path}/exposure", "site_id", BUCKETS)
    right = save_bucketed(loss, f"loss_{name}", f"{path}/loss", "site_id", BUCKETS)
    return join_colocated(left, right, "site_id").select("portfolio_id", "site_id", "cov2val", "loss")


def width_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.exposure(spark, sf_dir).select(
        "portfolio_id",
        "site_id",
        "cov2val",
        ops.exposure_bin(F.col("cov2val"), LOW, HIGH, BINS).alias("BIN"),
    )


def sql_udf_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_functions(spark)
    register(inputs.exposure(spark, sf_dir), EXPOSURE_VIEW)
    return spark.sql(
        f"SELECT portfolio_id, site_id, cov2val, WIDTH_BUCKET_1(cov2val, {LOW}, {HIGH}, {BINS}) "
        f"AS BIN FROM {EXPOSURE_VIEW}"
    )


def join_views_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = analysis_session(spark)
    register(inputs.exposure(session, sf_dir), EXPOSURE_VIEW)
    register(inputs.loss(session, sf_dir), LOSS_VIEW)
    joined = join_views(session, EXPOSURE_VIEW, LOSS_VIEW, "site_id")
    return joined.select("portfolio_id", "site_id", "cov2val", "loss")


def cross_join_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_totals(
        ops.max_exposure(inputs.exposure(spark, sf_dir)),
        inputs.loss(spark, sf_dir),
        top_loss=F.max("loss"),
        loss_sites=F.count("loss"),
    )


def peek_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peek(max_exposure(spark, sf_dir), ops.SITE_KEYS)


QUERIES = {
    "feature_scan": feature_scan,
    "feature_by_name": feature_by_name,
    "view_register": view_register,
    "view_chain": view_chain,
    "sql_statement": sql_statement,
    "coverage_sum": coverage_sums,
    "project_alias": project_alias,
    "join_views_broadcast": join_views_broadcast,
    "cross_join_views": cross_join_views,
    "max_exposure": max_exposure,
    "exposure_bins": exposure_bins,
    "exposure_bins_kept": exposure_bins_kept,
    "join_colocated_features": join_colocated_features,
    "peek_rows": peek_rows,
    "width_bucket": width_bucket,
    "sql_udf_register": sql_udf_register,
}

_TOTAL = "((l_quantity + l_extendedprice) + l_discount) + l_tax"
_MAX = (
    f"SELECT max({_TOTAL}) AS max_10, l_suppkey AS portfolio_id, l_partkey AS site_id "
    "FROM lineitem GROUP BY l_suppkey, l_partkey"
)


def _bin(value: str) -> str:
    return (
        f"CASE WHEN {value} < {LOW} THEN 0 WHEN {value} >= {HIGH} THEN {BINS + 1} "
        f"ELSE CAST(floor({BINS} * ({value} - {LOW}) / ({HIGH} - {LOW})) AS BIGINT) + 1 END"
    )


_BINS = (
    f"SELECT max_10, {_bin('max_10')} AS \"BIN\", portfolio_id, site_id FROM ({_MAX}) AS largest"
)
_ROW_BINS = (
    "SELECT l_suppkey AS portfolio_id, l_partkey AS site_id, l_extendedprice AS cov2val, "
    f"{_bin('l_extendedprice')} AS \"BIN\" FROM lineitem"
)
_JOINED = (
    "SELECT l_suppkey AS portfolio_id, l_partkey AS site_id, l_extendedprice AS cov2val, "
    "p_retailprice AS loss FROM lineitem JOIN part ON l_partkey = p_partkey"
)

ORACLES = {
    "feature_scan": (
        "SELECT l_suppkey AS portfolio_id, l_partkey AS site_id, l_quantity AS cov1val, "
        "l_extendedprice AS cov2val, l_discount AS cov3val, l_tax AS cov4val FROM lineitem"
    ),
    "feature_by_name": (
        "SELECT user_id AS site_id, value AS cov1val FROM events WHERE event_type = 'purchase'"
    ),
    "view_register": (
        "SELECT l_suppkey AS portfolio_id, count(*) AS locations FROM lineitem GROUP BY l_suppkey"
    ),
    "view_chain": _BINS,
    "sql_statement": (
        "SELECT l_suppkey AS portfolio_id, max(l_extendedprice) AS top_value, "
        "min(l_tax) AS low_value FROM lineitem WHERE l_quantity >= 10 GROUP BY l_suppkey"
    ),
    "coverage_sum": (
        f"SELECT l_suppkey AS portfolio_id, l_partkey AS site_id, {_TOTAL} AS total FROM lineitem"
    ),
    "project_alias": (
        "SELECT l_extendedprice AS value, l_quantity AS quantity, l_suppkey AS portfolio, "
        "l_partkey AS site FROM lineitem"
    ),
    "join_views_broadcast": _JOINED,
    "join_colocated_features": _JOINED,
    "cross_join_views": (
        f"SELECT largest.*, totals.* FROM ({_MAX}) AS largest CROSS JOIN "
        "(SELECT max(p_retailprice) AS top_loss, count(p_retailprice) AS loss_sites FROM part) "
        "AS totals"
    ),
    "max_exposure": _MAX,
    "exposure_bins": _BINS,
    "exposure_bins_kept": _BINS,
    "peek_rows": f"{_MAX} ORDER BY portfolio_id, site_id LIMIT 1",
    "width_bucket": _ROW_BINS,
    "sql_udf_register": _ROW_BINS,
}
