"""Load-test log queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import messages, sweep
from tallyfield.operators import reqlog as ops
from tallyfield.operators.cells import BITS, cell_percentiles, rt_cells
from tallyfield.operators.sketches import merge_sketches
from tallyfield.plans import inputs
from tallyfield.session import scratch_path
from tallyfield.sources.kept import keep_sketches, read_sketches
from tallyfield.sources.reqlog import read_reqlog, write_reqlog
from tallyfield.streaming import live, peaks

# Limits near the times in the given tables, so that some requests pass and some fail.
SLOW_MS = 3000
GOAL_MS, GOAL_PERCENT = 3000, 80
# A run in the middle of those given.
MIDDLE = "2024-01-16"
USER, STRETCH_MS = 7, (1_704_700_000_000, 1_706_000_000_000)
SETTLED_MS = 1_705_363_200_000


def reqlog_sink_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "reqlog")
    write_reqlog(inputs.request_log(spark, sf_dir), path)
    return read_reqlog(spark, path)


def reqlog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of one user in a stretch of time, out of a log that is sorted and has lookups."""
    path = scratch_path(spark, "reqlog")
    write_reqlog(inputs.request_log(spark, sf_dir), path, order=["start_ms"], lookups=["user_id"])
    stretch = F.col("start_ms").between(*STRETCH_MS)
    return read_reqlog(spark, path).where((F.col("user_id") == USER) & stretch).select("run_id", "id", "name", "start_ms", "rt_ms")


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.request_counts(inputs.request_log(spark, sf_dir))


def timed_out_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.timed_out(inputs.request_log(spark, sf_dir), SLOW_MS)


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.error_summary(inputs.request_log(spark, sf_dir))


def message_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.message_templates(inputs.request_log(spark, sf_dir))


def rt_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rt_indicators(inputs.request_log(spark, sf_dir))


def rt_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rt_percentiles(inputs.request_log(spark, sf_dir))


def rt_percentiles_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are kept in two lots, one of them twice; the percentiles come from the kept sketches alone."""
    log, path = inputs.request_log(spark, sf_dir), scratch_path(spark, "sketches")
    keep_sketches(log.where(F.col("run_id") < MIDDLE), path)
    keep_sketches(log.where(F.col("run_id") >= MIDDLE), path)
    keep_sketches(log.where(F.col("run_id") == MIDDLE), path)
    return merge_sketches(read_sketches(spark, path))


def rt_percentiles_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are counted run by run, and the percentiles come from their sum."""
    return cell_percentiles(rt_cells(inputs.request_log(spark, sf_dir), ["run_id", "name"]))


def rt_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rt_rollup(inputs.request_log(spark, sf_dir))


def rt_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rt_histogram(inputs.request_log(spark, sf_dir))


def rt_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rt_series(inputs.request_log(spark, sf_dir))


def slo_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.slo_check(inputs.request_log(spark, sf_dir), GOAL_MS, GOAL_PERCENT)


def scenario_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scenario_spans(inputs.request_log(spark, sf_dir))


def group_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.group_durations(inputs.group_log(spark, sf_dir))


def open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.open_requests(inputs.overlapping_log(spark, sf_dir))


def max_open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.max_open(inputs.overlapping_log(spark, sf_dir))


def open_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.open_series(inputs.overlapping_log(spark, sf_dir))


def open_requests_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.max_open(inputs.overlapping_log(spark, sf_dir), keys=())


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.max_open(ops.scenario_spans(inputs.overlapping_log(spark, sf_dir)))


def _events_stream(session: SparkSession, sf_dir: str) -> DataFrame:
    schema = inputs.table(session, sf_dir, "events").schema
    # A stream takes a folder or a pattern; this pattern fits the table as one file or a folder.
    return session.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def live_metrics_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record comes twice and counts once; intervals that the watermark has closed."""
    events = _events_stream(spark, sf_dir)
    twice = inputs.as_request_log(events).withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2))))
    path = scratch_path(spark, "live")
    metrics = live.live_metrics(twice, "1 minute", once=["run_id", "id"])
    live.append_metrics(metrics, f"{path}/metrics", f"{path}/checkpoint", every=None).awaitTermination()
    return spark.read.schema(metrics.schema).parquet(f"{path}/metrics")


def live_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log streams in; what is over by the middle of it is settled, and the peaks are read."""
    path, settled = scratch_path(spark, "peaks"), scratch_path(spark, "peaks")
    log = inputs.as_overlapping_log(_events_stream(spark, sf_dir))
    peaks.stream_changes(log, f"{path}/kept", f"{path}/checkpoint").awaitTermination()
    peaks.settle(spark, f"{path}/kept", settled, SETTLED_MS)
    return peaks.read_peaks(spark, settled)


def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events_stream(live.update_session(spark), sf_dir)
    path = scratch_path(spark, "live")
    metrics = live.live_metrics(inputs.log_with_total_name(events))
    live.update_metrics(metrics, f"{path}/metrics", f"{path}/checkpoint").awaitTermination()
    return live.read_updates(spark, f"{path}/metrics")


QUERIES = {
    "reqlog_sink_scan": reqlog_sink_scan,
    "reqlog_lookup": reqlog_lookup,
    "request_counts": request_counts,
    "timed_out_requests": timed_out_requests,
    "error_summary": error_summary,
    "message_templates": message_templates,
    "rt_indicators": rt_indicators,
    "rt_percentiles": rt_percentiles,
    "rt_percentiles_kept": rt_percentiles_kept,
    "rt_percentiles_cells": rt_percentiles_cells,
    "rt_rollup": rt_rollup,
    "rt_histogram": rt_histogram,
    "rt_series": rt_series,
    "slo_check": slo_check,
    "scenario_spans": scenario_spans,
    "group_durations": group_durations,
    "open_requests": open_requests,
    "max_open_requests": max_open_requests,
    "open_series": open_series,
    "open_requests_global": open_requests_global,
    "active_users": active_users,
    "live_metrics": live_metrics,
    "live_metrics_once": live_metrics_once,
    "live_peak": live_peak,
}

_LOG = """
    WITH started AS (
      SELECT *, epoch_us(ts) // 1000 AS start_ms, CAST(floor(value * 10) AS BIGINT) AS rt_ms
      FROM events),
    log AS (
      SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS run_id, 'main' AS scenario, user_id,
             event_type AS name, start_ms, start_ms + rt_ms AS end_ms,
             CASE event_type WHEN 'error' THEN 'KO' ELSE 'OK' END AS status,
             CASE event_type WHEN 'error' THEN props END AS message, rt_ms,
             start_ms + rt_ms // 4 AS request_end_ms, start_ms + rt_ms // 2 AS response_start_ms
      FROM started)
"""
_PERCENT_OK = "CAST(100 * count(*) FILTER (status = 'OK') AS DOUBLE) / count(*)"
_STATS = (
    "count(*) AS requests, count(*) FILTER (status = 'OK') AS ok, "
    "count(*) FILTER (status = 'KO') AS ko, min(rt_ms) AS min_ms, max(rt_ms) AS max_ms, "
    "CAST(sum(rt_ms) AS DOUBLE) / count(*) AS mean_ms FROM log"
)
_LIVE = (
    "count(*) AS requests, count(*) FILTER (status = 'KO') AS failed, max(rt_ms) AS max_ms, "
    "CAST(sum(rt_ms) AS DOUBLE) / count(*) AS mean_ms FROM log"
)


def _percentile(p: int) -> str:
    rank = f"((len(v) - 1) * CAST({p / 100} AS DOUBLE))"
    low, high = f"v[CAST(floor({rank}) AS BIGINT) + 1]", f"v[CAST(ceil({rank}) AS BIGINT) + 1]"
    return f"{low} + ({high} - {low}) * ({rank} - floor({rank})) AS p{p}"


def _cell_middle(p: int) -> str:
    """The middle of the cell of the percentile: its leading digits, and half of what follows them."""
    value = f"v[greatest(CAST(ceil(len(v) * CAST({p / 100} AS DOUBLE)) AS BIGINT), 1)]"
    width = f"CAST(1 AS BIGINT) << greatest(length(bin({value})) - {BITS + 1}, 0)"
    return f"CAST({value} // ({width}) * ({width}) + (({width}) - 1) // 2 AS BIGINT) AS p{p}"


def _changes(spans: str) -> str:
    """Running sums over the start and end instants of ``spans``, per run and over all runs."""
    return f"""{_LOG},
        long AS (SELECT run_id, scenario, user_id, start_ms,
                        CASE WHEN id % 10 <> 0 THEN start_ms + rt_ms * 1000 END AS end_ms
                 FROM log),
        spans AS ({spans}),
        edges AS (SELECT run_id, start_ms AS at_ms, 1 AS step FROM spans
                  UNION ALL SELECT run_id, end_ms, -1 FROM spans WHERE end_ms IS NOT NULL),
        changes AS (SELECT run_id, at_ms, CAST(sum(step) AS BIGINT) AS change
                    FROM edges GROUP BY run_id, at_ms),
        running AS (SELECT run_id, at_ms, change, CAST(sum(change) OVER (
                      PARTITION BY run_id ORDER BY at_ms) AS BIGINT) AS open FROM changes),
        instants AS (SELECT at_ms, sum(step) AS change FROM edges GROUP BY at_ms),
        overall AS (SELECT CAST(sum(change) OVER (ORDER BY at_ms) AS BIGINT) AS open
                    FROM instants)
    """


_REQUESTS = _changes("SELECT * FROM long")
_USERS = _changes(
    "SELECT run_id, scenario, user_id, min(start_ms) AS start_ms, "
    "CASE WHEN count(*) = count(end_ms) THEN max(end_ms) END AS end_ms "
    "FROM long GROUP BY run_id, scenario, user_id"
)
_MAX_PER_RUN = "SELECT run_id, max(open) AS max_open FROM running GROUP BY run_id"

_SPLIT = "string_split_regex(text, '[ \\t\\r\\n]+')"


def _message_level(level: int) -> str:
    """The tree of messages with one level more."""
    n, token = level + 1, f"coalesce(tokens[{level + 1}], '')"
    return f"""level{n} AS (
          SELECT text, failures, node || chr(10) || CASE WHEN wide THEN '<*>' ELSE {token} END AS node,
                 CASE WHEN wide THEN list_concat(list_concat(tokens[1:{level}], ['<*>']), tokens[{level + 2}:]) ELSE tokens END AS tokens
          FROM level{level} JOIN (SELECT node, count(DISTINCT {token}) > {messages.CHILDREN} AS wide
                                  FROM level{level} GROUP BY node) USING (node))"""


_MESSAGES = f"""{_LOG},
        texts AS (SELECT regexp_replace(message, '[0-9]+', '<*>', 'g') AS text, count(*) AS failures
                  FROM log WHERE status = 'KO' GROUP BY 1),
        level0 AS (SELECT text, failures, {_SPLIT} AS tokens, CAST(len({_SPLIT}) AS VARCHAR) AS node FROM texts),
        {", ".join(_message_level(level) for level in range(messages.DEPTH))},
        placed AS (SELECT text, failures, node, unnest(tokens) AS token, unnest(range(len(tokens))) AS place
                   FROM level{messages.DEPTH}),
        varying AS (SELECT node, place, count(DISTINCT token) > {messages.CHILDREN} AS varies FROM placed GROUP BY 1, 2),
        named AS (SELECT text, any_value(failures) AS failures,
                         string_agg(CASE WHEN varies THEN '<*>' ELSE token END, ' ' ORDER BY place) AS template
                  FROM placed JOIN varying USING (node, place) GROUP BY text)
        SELECT template, CAST(sum(failures) AS BIGINT) AS failures, count(*) AS messages FROM named GROUP BY template
        UNION ALL SELECT NULL, failures, 0 FROM texts WHERE text IS NULL
    """

ORACLES = {
    "reqlog_sink_scan": f"{_LOG} SELECT * FROM log",
    "reqlog_lookup": (
        f"{_LOG} SELECT run_id, id, name, start_ms, rt_ms FROM log "
        f"WHERE user_id = {USER} AND start_ms BETWEEN {STRETCH_MS[0]} AND {STRETCH_MS[1]}"
    ),
    "request_counts": (
        f"{_LOG} SELECT run_id, count(*) AS requests, count(*) FILTER (status = 'KO') AS failed, "
        f"{_PERCENT_OK} AS percent_ok, max(end_ms) - min(start_ms) AS uptime_ms "
        "FROM log GROUP BY run_id"
    ),
    "timed_out_requests": (
        f"{_LOG} SELECT run_id, count(*) FILTER (rt_ms > {SLOW_MS}) AS timed_out "
        "FROM log GROUP BY run_id"
    ),
    "error_summary": (
        f"{_LOG} SELECT run_id, message, count(*) AS failures, CAST(100 * count(*) AS DOUBLE) / "
        "sum(count(*)) OVER (PARTITION BY run_id) AS percent FROM log WHERE status = 'KO' "
        "GROUP BY run_id, message ORDER BY failures DESC, run_id, message"
    ),
    "rt_indicators": f"""{_LOG}
        SELECT run_id,
               count(*) FILTER (status = 'OK' AND rt_ms < {ops.LOWER_BOUND_MS}) AS below,
               count(*) FILTER (status = 'OK' AND rt_ms >= {ops.LOWER_BOUND_MS}
                                AND rt_ms < {ops.HIGHER_BOUND_MS}) AS between,
               count(*) FILTER (status = 'OK' AND rt_ms >= {ops.HIGHER_BOUND_MS}) AS above,
               count(*) FILTER (status = 'KO') AS failed
        FROM log GROUP BY run_id
    """,
    # Spelt out: quantile_cont interpolates with a fused multiply-add, which moves the last bit.
    "rt_percentiles": (
        f"{_LOG}, sorted AS (SELECT name, list(rt_ms ORDER BY rt_ms) AS v FROM log GROUP BY name) "
        "SELECT name, " + ", ".join(map(_percentile, ops.PERCENTS)) + " FROM sorted"
    ),
    # Exact while a name has no more times than a sketch holds, as at the scale of this check.
    "rt_percentiles_kept": (
        f"{_LOG}, sorted AS (SELECT name, list(rt_ms ORDER BY rt_ms) AS v FROM log GROUP BY name), "
        f"stats AS (SELECT name, {_STATS.replace(' FROM log', '')} FROM log GROUP BY name) "
        "SELECT name, requests, ok, ko, min_ms, max_ms, mean_ms, "
        + ", ".join(f"v[CAST(ceil(len(v) * {p / 100}) AS BIGINT)] AS p{p}" for p in ops.PERCENTS)
        + " FROM sorted JOIN stats USING (name)"
    ),
    "rt_percentiles_cells": (
        f"{_LOG}, sorted AS (SELECT name, list(rt_ms ORDER BY rt_ms) AS v FROM log GROUP BY name) "
        "SELECT name, len(v) AS requests, " + ", ".join(map(_cell_middle, ops.PERCENTS)) + " FROM sorted"
    ),
    "rt_rollup": (
        f"{_LOG} SELECT name, false AS is_all, {_STATS} GROUP BY name "
        f"UNION ALL SELECT 'all', true, {_STATS}"
    ),
    "rt_histogram": (
        f"{_LOG} SELECT name, rt_ms // {ops.CELL_MS} * {ops.CELL_MS} AS cell_ms, "
        "count(*) AS requests FROM log GROUP BY 1, 2"
    ),
    "rt_series": f"""{_LOG},
        bounds AS (SELECT run_id, min(start_ms) AS first, max(start_ms) AS last
                   FROM log GROUP BY run_id)
        SELECT run_id, name, (start_ms - first) * {ops.MAX_POINTS} // (last - first + 1) AS point,
               count(*) AS requests, count(*) FILTER (status = 'KO') AS failed
        FROM log JOIN bounds USING (run_id) GROUP BY 1, 2, 3
    """,
    "slo_check": (
        f"{_LOG} SELECT run_id, max(rt_ms) AS max_ms, {_PERCENT_OK} AS percent_ok, "
        f"max(rt_ms) < {GOAL_MS} AS max_met, {_PERCENT_OK} > {GOAL_PERCENT} AS percent_met "
        "FROM log GROUP BY run_id"
    ),
    "scenario_spans": (
        f"{_LOG} SELECT run_id, scenario, user_id, min(start_ms) AS start_ms, "
        "max(end_ms) AS end_ms, max(end_ms) - min(start_ms) AS length_ms "
        "FROM log GROUP BY run_id, scenario, user_id"
    ),
    "group_durations": f"""{_LOG},
        passes AS (SELECT name, max(end_ms) - min(start_ms) AS took,
                          count(*) FILTER (status = 'KO') AS ko
                   FROM log GROUP BY run_id, scenario, user_id, name)
        SELECT name, count(*) AS passes, CAST(sum(took) AS DOUBLE) / count(*) AS mean_ms,
               max(took) AS max_ms, count(*) FILTER (ko > 0) AS failed
        FROM passes GROUP BY name
    """,
    "open_requests": f"{_REQUESTS} SELECT run_id, at_ms, change, open FROM running",
    "max_open_requests": f"{_REQUESTS} {_MAX_PER_RUN}",
    # Each stretch between neighbouring instants, the bounds of the steps among them, with its level.
    "open_series": f"""{_REQUESTS},
        ends AS (SELECT run_id, min(at_ms) AS first, max(at_ms) AS last FROM changes GROUP BY run_id),
        steps AS (
          SELECT run_id, point, first + (point * (last - first + 1) + {ops.MAX_POINTS - 1}) // {ops.MAX_POINTS} AS from_ms,
                 first + ((point + 1) * (last - first + 1) + {ops.MAX_POINTS - 1}) // {ops.MAX_POINTS} AS to_ms
          FROM ends, range({ops.MAX_POINTS}) AS r(point)),
        cuts AS (SELECT run_id, at_ms, sum(change) AS change FROM (
                   SELECT run_id, at_ms, change FROM changes
                   UNION ALL SELECT run_id, from_ms, 0 FROM steps WHERE to_ms > from_ms)
                 GROUP BY run_id, at_ms),
        levels AS (
          SELECT run_id, at_ms, sum(change) OVER (PARTITION BY run_id ORDER BY at_ms) AS open,
                 coalesce(lead(at_ms) OVER (PARTITION BY run_id ORDER BY at_ms), last + 1) AS until
          FROM cuts JOIN ends USING (run_id))
        SELECT run_id, point, from_ms, to_ms, CAST(max(open) AS BIGINT) AS peak,
               CAST(sum(open * (until - at_ms)) AS BIGINT) AS area,
               CAST(sum(open * (until - at_ms)) AS DOUBLE) / (to_ms - from_ms) AS mean_open
        FROM levels JOIN steps USING (run_id) WHERE at_ms >= from_ms AND at_ms < to_ms
        GROUP BY run_id, point, from_ms, to_ms
    """,
    "open_requests_global": f"{_REQUESTS} SELECT max(open) AS max_open FROM overall",
    "active_users": f"{_USERS} {_MAX_PER_RUN}",
    "live_metrics_once": (
        f"{_LOG}, closed AS (SELECT * FROM log WHERE start_ms // 60000 * 60000 + 60000 <= "
        "(SELECT max(start_ms) FROM log) - 60000) "
        f"SELECT start_ms // 60000 * 60000 AS window_ms, name, false AS is_all, {_LIVE.replace('FROM log', 'FROM closed')} "
        f"GROUP BY 1, 2 UNION ALL SELECT start_ms // 60000 * 60000, 'all', true, {_LIVE.replace('FROM log', 'FROM closed')} GROUP BY 1"
    ),
    "live_peak": f"""{_REQUESTS},
        now AS (SELECT run_id, CAST(sum(change) AS BIGINT) AS open_now FROM changes GROUP BY run_id)
        SELECT run_id, max(open) AS max_open, any_value(open_now) AS open_now, CAST(0 AS BIGINT) AS late
        FROM running JOIN now USING (run_id) GROUP BY run_id
    """,
    "message_templates": _MESSAGES,
    "live_metrics": (
        f"{_LOG} SELECT start_ms // 1000 * 1000 AS window_ms, CASE name WHEN 'purchase' THEN 'all' "
        f"ELSE name END AS name, false AS is_all, {_LIVE} GROUP BY 1, 2 "
        f"UNION ALL SELECT start_ms // 1000 * 1000, 'all', true, {_LIVE} GROUP BY 1"
    ),
}
