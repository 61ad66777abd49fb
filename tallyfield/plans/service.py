"""Session, statement and text queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.dates import try_date
from tallyfield.functions.matching import full_match
from tallyfield.operators import sessions as ops
from tallyfield.operators import statements
from tallyfield.plans import inputs

# A limit near the times in the given tables, so that some statements are over it.
SLOW_MS = 3000
TEXT_PATTERN = ".*on.*"
RESULT_PATTERN = "user 1.*"
EVALUE_PATTERN = "step [1-4]."
TRACE_PATTERN = "at step .*for user 1.*"


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.active_sessions(inputs.sessions(spark, sf_dir)).select("cluster", "id", "state")


def first_active_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_active(inputs.sessions(spark, sf_dir), ["cluster"])


def active_session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.active_positions(inputs.sessions(spark, sf_dir), ["cluster"])


def regex_full_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.table(spark, sf_dir, "conversations")
    return turns.where(full_match(F.col("text"), TEXT_PATTERN))


def _flat(decoded: DataFrame, lines: str) -> DataFrame:
    return decoded.withColumn(lines, F.array_join(lines, "\n"))


def statement_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(statements.decode_statements(inputs.statement_replies(spark, sf_dir)), "trace")


def error_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = statements.decode_statements(inputs.statement_replies(spark, sf_dir))
    matched = statements.error_match(decoded, evalue=EVALUE_PATTERN, trace=TRACE_PATTERN)
    return _flat(matched.select("event_id", "ename", "evalue", "trace"), "trace")


def result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = statements.decode_statements(inputs.statement_replies(spark, sf_dir))
    return statements.result_match(decoded, RESULT_PATTERN).select("event_id", "text")


def session_list_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = statements.decode_session_lists(inputs.session_list_replies(spark, sf_dir))
    return lists.select("o_orderkey", "position", "session_id", "app_id", "state")


def session_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(statements.decode_sessions(inputs.session_replies(spark, sf_dir)), "log")


def statement_time_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.statement_times(inputs.statement_log(spark, sf_dir))


def slow_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.slow_statements(inputs.statement_log(spark, sf_dir), SLOW_MS)


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.session_at_start(inputs.stated_log(spark, sf_dir), inputs.session_changes(spark, sf_dir))


def statement_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir)


def statement_time_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.statement_times_by_state(_stated(spark, sf_dir))


def try_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.date_texts(spark, sf_dir).withColumn("parsed", try_date(F.col("text")))


QUERIES = {
    "active_sessions": active_sessions,
    "first_active_session": first_active_session,
    "active_session_list": active_session_list,
    "regex_full_match": regex_full_match,
    "error_match": error_match,
    "result_match": result_match,
    "statement_time_by_session": statement_time_by_session,
    "slow_statements": slow_statements,
    "statement_state": statement_state,
    "statement_time_by_state": statement_time_by_state,
    "try_parse_date": try_parse_date,
    "statement_decode": statement_decode,
    "session_decode": session_decode,
    "session_list_decode": session_list_decode,
}

_STEP = "regexp_extract(props, '([0-9]+)', 1)"
_TRACE = f"'at step ' || {_STEP} || chr(10) || 'for user ' || user_id"
_STATED = """
    WITH log AS (
      SELECT event_id, user_id AS session_id, event_type, epoch_us(ts) // 1000 * 1000000 AS start_ns,
             CAST(floor(value * 10) AS BIGINT) * 1000000 AS taken
      FROM events),
    changes AS (
      SELECT session_id, start_ns AS changed_ns, arg_max(
               CASE event_type WHEN 'signup' THEN 'Starting' WHEN 'purchase' THEN 'RUNNING' ELSE 'dead' END,
               event_id) AS state
      FROM log WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY session_id, start_ns),
    stated AS (
      SELECT l.event_id AS statement_id, l.session_id, start_ns, start_ns + taken AS end_ns, state,
             changed_ns AS state_since_ns, coalesce(lower(state) IN ('idle', 'starting', 'running'), false) AS active
      FROM (SELECT * FROM log WHERE event_type IN ('view', 'click', 'error')) AS l
      ASOF LEFT JOIN changes AS c ON l.session_id = c.session_id AND l.start_ns >= c.changed_ns)
"""

ORACLES = {
    "statement_state": f"{_STATED} SELECT * FROM stated",
    "statement_time_by_state": (
        f"{_STATED} SELECT state, active, count(*) AS statements, avg(end_ns - start_ns) / 1e9 AS mean_s, "
        "max(end_ns - start_ns) / 1e9 AS max_s FROM stated GROUP BY state, active"
    ),
    "active_sessions": (
        "SELECT o_custkey AS cluster, o_orderkey AS id, "
        "CASE o_orderstatus WHEN 'F' THEN 'Idle' ELSE 'STARTING' END AS state "
        "FROM orders WHERE o_orderstatus IN ('F', 'O')"
    ),
    "first_active_session": (
        "SELECT o_custkey AS cluster, coalesce(min(CASE WHEN o_orderstatus IN ('F', 'O') "
        "THEN o_orderkey END), 0) AS first_active_id FROM orders GROUP BY o_custkey"
    ),
    "active_session_list": (
        "SELECT o_custkey AS cluster, o_orderkey AS session_id, "
        "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank "
        "FROM orders WHERE o_orderstatus IN ('F', 'O')"
    ),
    "regex_full_match": (
        "SELECT conv_id, turn, role, text FROM conversations "
        f"WHERE regexp_full_match(text, '{TEXT_PATTERN}', 's')"
    ),
    "error_match": (
        f"SELECT event_id, 'StepError' AS ename, 'step ' || {_STEP} AS evalue, {_TRACE} AS trace "
        f"FROM events WHERE event_type = 'error' AND "
        f"regexp_full_match('step ' || {_STEP}, '{EVALUE_PATTERN}', 's') AND "
        f"regexp_full_match({_TRACE}, '{TRACE_PATTERN}', 's')"
    ),
    "result_match": (
        "SELECT event_id, 'user ' || user_id AS text FROM events WHERE event_type = 'click' "
        f"AND regexp_full_match('user ' || user_id, '{RESULT_PATTERN}', 's')"
    ),
    "session_list_decode": """
        SELECT o_orderkey, CAST(0 AS INTEGER) AS position, o_orderkey AS session_id,
               CASE WHEN o_orderstatus <> 'P' THEN 'app_' || o_custkey END AS app_id,
               CASE o_orderstatus WHEN 'F' THEN 'idle' WHEN 'O' THEN 'starting' ELSE 'dead' END
                 AS state
        FROM orders
        UNION ALL
        SELECT o_orderkey, CAST(1 AS INTEGER), o_custkey, CAST(NULL AS VARCHAR), 'running'
        FROM orders
    """,
    "statement_time_by_session": """
        WITH log AS (
          SELECT user_id AS session_id, CAST(floor(value * 10) AS BIGINT) * 1000000 AS taken
          FROM events)
        SELECT session_id, count(*) AS statements, avg(taken) / 1e9 AS mean_s,
               max(taken) / 1e9 AS max_s FROM log GROUP BY session_id
    """,
    "slow_statements": (
        "SELECT user_id AS session_id, "
        f"count(*) FILTER (CAST(floor(value * 10) AS BIGINT) > {SLOW_MS}) AS over_limit "
        "FROM events GROUP BY user_id"
    ),
    "try_parse_date": """
        SELECT o_orderkey,
               CASE o_orderpriority
                 WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-') || '13-45'
                 WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d') || 'abc'
                 WHEN '4-NOT SPECIFIED' THEN ''
                 ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text,
               CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW')
                 THEN CAST(o_orderdate AS DATE) END AS parsed
        FROM orders
    """,
    "statement_decode": f"""
        WITH kinds AS (
          SELECT *, CASE WHEN event_type <> 'signup' THEN event_type WHEN value < 5 THEN 'running'
                 WHEN value < 20 THEN 'odd' ELSE 'cut' END AS kind FROM events)
        SELECT event_id,
               CASE kind WHEN 'error' THEN 'error' WHEN 'running' THEN 'pending'
                 WHEN 'odd' THEN 'invalid' WHEN 'cut' THEN 'invalid' ELSE 'ok' END AS outcome,
               CASE WHEN kind <> 'cut' THEN event_id END AS statement_id,
               CASE kind WHEN 'cut' THEN NULL WHEN 'running' THEN 'running'
                 ELSE 'available' END AS state,
               CASE kind WHEN 'view' THEN '{{"step":' || {_STEP} || '}}'
                 WHEN 'click' THEN 'user ' || user_id WHEN 'purchase' THEN '' END AS text,
               CASE kind WHEN 'error' THEN 'StepError' END AS ename,
               CASE kind WHEN 'error' THEN 'step ' || {_STEP} END AS evalue,
               CASE kind WHEN 'error' THEN {_TRACE} END AS trace
        FROM kinds
    """,
    "session_decode": """
        SELECT o_orderkey, o_orderkey AS session_id,
               CASE WHEN o_orderstatus <> 'P' THEN 'app_' || o_custkey END AS app_id,
               CASE o_orderstatus WHEN 'F' THEN 'idle' WHEN 'O' THEN 'starting' ELSE 'dead' END
                 AS state,
               CAST(NULL AS VARCHAR) AS driver_log_url,
               CASE WHEN o_orderstatus <> 'P' THEN '/ui/' || o_custkey END AS spark_ui_url,
               'stdout: ' || chr(10) || o_orderpriority AS log
        FROM orders
    """,
}
