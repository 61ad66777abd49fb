import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.operators.reqlog import (
    error_summary,
    group_durations,
    request_counts,
    rt_histogram,
    rt_indicators,
    rt_percentiles,
    rt_rollup,
    rt_series,
    scenario_spans,
    slo_check,
    timed_out,
)
from tallyfield.session import scratch_path
from tallyfield.sources.reqlog import (
    GROUP_SCHEMA,
    REQUEST_SCHEMA,
    RUN_SCHEMA,
    SCENARIO_SCHEMA,
    read_reqlog,
    write_reqlog,
)
from tests.plans import executed_plan


def record(run="r", name="n", start=0, rt=10, status="OK", message=None, user=1, i=0):
    return (i, run, "main", user, name, start, start + rt, status, message, rt, start + 1, start + 2)


def log_of(spark, *records):
    return spark.createDataFrame(list(records), REQUEST_SCHEMA)


@pytest.fixture(scope="module")
def skewed(spark):
    """600 requests; one run and one name hold most of them."""
    rng = random.Random(5)
    return [
        record(
            run="hot" if rng.random() < 0.7 else rng.choice(["r1", "r2", None]),
            name="hot" if rng.random() < 0.7 else rng.choice(["a", "b"]),
            start=rng.randint(0, 50_000_000) if rng.random() < 0.7 else 1_000_000,
            rt=int(rng.expovariate(1 / 700)),
            status=rng.choice(["OK", "OK", "KO"]),
            message=rng.choice(["m1", "m1", "m2", None]),
            user=rng.randint(1, 9),
            i=i,
        )
        for i in range(600)
    ]


def test_counts(spark):
    log = log_of(spark, record(start=5, rt=10), record(start=1, rt=3, status="KO"), record(run="s"))
    got = {r.run_id: tuple(r)[1:] for r in request_counts(log).collect()}
    assert got == {"r": (2, 1, 50.0, 14), "s": (1, 0, 100.0, 10)}


def test_empty_log(spark):
    log = log_of(spark)
    for job in (
        request_counts, timed_out, error_summary, rt_indicators, rt_percentiles, rt_histogram,
        rt_series, slo_check, scenario_spans,
    ):
        assert job(log).collect() == []


def test_timed_out_means_longer(spark):
    log = log_of(spark, record(rt=40_000), record(rt=40_001))
    assert [r.timed_out for r in timed_out(log).collect()] == [1]


def test_indicator_bounds(spark):
    log = log_of(spark, *[record(rt=t) for t in (0, 799, 800, 1199, 1200)], record(rt=1, status="KO"))
    assert [tuple(r)[1:] for r in rt_indicators(log).collect()] == [(2, 2, 1, 1)]


@pytest.mark.parametrize(("ok", "met"), [(95, False), (96, True)])
def test_goal_is_more_than_95_percent(spark, ok, met):
    log = log_of(spark, *[record(status="OK" if i < ok else "KO") for i in range(100)])
    row = slo_check(log).first()
    assert (row.percent_met, row.max_met) == (met, True)


def test_goal_is_under_50_ms(spark):
    log = log_of(spark, record(run="a", rt=49), record(run="b", rt=50), record(run="c", status="KO"))
    got = {r.run_id: (r.max_met, r.percent_met) for r in slo_check(log).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (True, False)}


def test_errors(spark, skewed):
    want = {}
    for r in skewed:
        if r[7] == "KO":
            want[r[1], r[8]] = want.get((r[1], r[8]), 0) + 1
    totals = {}
    for (run, _), n in want.items():
        totals[run] = totals.get(run, 0) + n
    rows = error_summary(log_of(spark, *skewed)).collect()
    assert {(r.run_id, r.message): r.failures for r in rows} == want
    assert all(r.percent == 100.0 * r.failures / totals[r.run_id] for r in rows)
    counts = [r.failures for r in rows]
    assert counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("bits", [4, 21])
def test_percentiles(spark, skewed, bits):
    percents = (0, 50, 75, 95, 99, 99.9, 100)
    log = log_of(spark, *skewed)
    got = rt_percentiles(log, percents, bits=bits)
    assert got.columns == ["name", "p0", "p50", "p75", "p95", "p99", "p99_9", "p100"]
    times = {}
    for r in skewed:
        times.setdefault(r[4], []).append(r[9])
    builtin = log.groupBy("name").agg(F.percentile("rt_ms", F.lit([p / 100 for p in percents])).alias("p"))
    builtin = {r.name: r.p for r in builtin.collect()}
    for row in got.collect():
        values = ", ".join(f"({t})" for t in times[row.name])
        duck = duckdb.execute(
            f"SELECT quantile_cont(v, {[p / 100 for p in percents]}) FROM (VALUES {values}) AS t(v)"
        ).fetchone()[0]
        assert list(row)[1:] == pytest.approx(duck, rel=1e-12)
        assert list(row)[1:] == pytest.approx(builtin[row.name], rel=1e-12)


def test_percentiles_of_one_request(spark):
    log = log_of(spark, record(rt=7), (1, "r", "main", 1, "m", 0, None, "OK", None, None, None, None))
    assert [tuple(r) for r in rt_percentiles(log).collect()] == [("n", 7.0, 7.0, 7.0, 7.0)]


def test_approximate_percentiles(spark):
    """The sketch keeps its promise: the rank of its answer is within n / accuracy."""
    times = random.Random(1).sample(range(100_000), 5000)
    log = log_of(spark, *[record(rt=t) for t in times])
    row = rt_percentiles(log, exact=False, accuracy=500).first()
    for p, value in zip((50, 75, 95, 99), list(row)[1:]):
        rank = sum(t <= value for t in times)
        assert abs(rank - p / 100 * 5000) <= 5000 / 500 + 1


def test_rollup(spark, skewed):
    extra = record(name=None, rt=5)
    rows = rt_rollup(log_of(spark, *skewed, extra)).collect()
    everything = [r for r in rows if r.is_all]
    named = [r for r in rows if not r.is_all]
    assert [r.name for r in everything] == ["all"]
    assert None in {r.name for r in named}
    for column in ("requests", "ok", "ko"):
        assert everything[0][column] == sum(r[column] for r in named)
    assert everything[0].max_ms == max(r[9] for r in skewed)
    assert everything[0].mean_ms == pytest.approx((sum(r[9] for r in skewed) + 5) / 601)


def test_histogram(spark):
    log = log_of(spark, *[record(rt=t) for t in (0, 9, 10, 19, 20, -1)])
    assert {r.cell_ms: r.requests for r in rt_histogram(log).collect()} == {-10: 1, 0: 2, 10: 2, 20: 1}


@pytest.mark.parametrize("points", [1, 7, 1000])
def test_series(spark, skewed, points):
    bounds = {}
    for r in skewed:
        low, high = bounds.get(r[1], (r[5], r[5]))
        bounds[r[1]] = (min(low, r[5]), max(high, r[5]))
    want = {}
    for r in skewed:
        low, high = bounds[r[1]]
        key = (r[1], r[4], (r[5] - low) * points // (high - low + 1))
        n, ko = want.get(key, (0, 0))
        want[key] = (n + 1, ko + (r[7] == "KO"))
    got = rt_series(log_of(spark, *skewed), points).collect()
    assert {(r.run_id, r.name, r.point): (r.requests, r.failed) for r in got} == want
    assert max(r.point for r in got) < points


def test_series_is_lazy_and_counts_once(spark, skewed):
    path = scratch_path(spark, "growing")
    write_reqlog(log_of(spark, *skewed), path)
    df = rt_series(read_reqlog(spark, path), 10)
    df.collect()
    assert "ReusedExchange" in executed_plan(df)
    early = rt_series(read_reqlog(spark, path), 10)
    write_reqlog(log_of(spark, record(run="new"), record(run="hot", start=90_000_000)), path)
    # Called before the rows came: bounds and counts are still of the same rows.
    assert {r.point for r in early.collect()} <= set(range(10))
    got = rt_series(read_reqlog(spark, path), 10).collect()
    assert {r.point for r in got} <= set(range(10))
    assert "new" in {r.run_id for r in got} and sum(r.requests for r in got) == len(skewed) + 2


def test_spans_and_groups(spark):
    log = log_of(spark, record(start=5, rt=5), record(start=1, rt=1), record(user=2, start=3, rt=4))
    got = {r.user_id: (r.start_ms, r.end_ms, r.length_ms) for r in scenario_spans(log).collect()}
    assert got == {1: (1, 10, 9), 2: (3, 7, 4)}
    rows = [("r", "main", 1, "g", 0, 10, "OK"), ("r", "main", 2, "g", 5, 10, "KO")]
    groups = spark.createDataFrame(rows, GROUP_SCHEMA)
    assert [tuple(r) for r in group_durations(groups).collect()] == [("g", 2, 7.5, 10, 1)]


def test_sink_appends_and_prunes(spark):
    path = scratch_path(spark, "log")
    first = [record(run=f"2024-01-0{1 + i % 3}", i=i) for i in range(9)]
    second = [record(run="2024-01-01", i=100, status="KO", message="m")]
    write_reqlog(log_of(spark, *first), path)
    write_reqlog(log_of(spark, *second), path)
    back = read_reqlog(spark, path)
    assert back.schema == StructType.fromDDL(
        "id BIGINT, scenario STRING, user_id BIGINT, name STRING, start_ms BIGINT, end_ms BIGINT, "
        "status STRING, message STRING, rt_ms BIGINT, request_end_ms BIGINT, "
        "response_start_ms BIGINT, run_id STRING"
    )
    assert sorted(back.select(*log_of(spark).columns).collect()) == sorted(
        log_of(spark, *first, *second).collect()
    )
    one = back.where("run_id = '2024-01-01'")
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(run_id" in executed_plan(one)
    write_reqlog(log_of(spark, *second), path, replace_runs=True)
    assert back.where("run_id <> '2024-01-01'").count() == 6
    assert [r.id for r in read_reqlog(spark, path).where("run_id = '2024-01-01'").collect()] == [100]


@pytest.mark.parametrize("schema", [RUN_SCHEMA, SCENARIO_SCHEMA, GROUP_SCHEMA])
def test_sink_takes_the_other_records(spark, schema):
    path = scratch_path(spark, "records")
    empty = spark.createDataFrame([], schema)
    row = ["x" if f.dataType.simpleString() == "string" else None for f in empty.schema]
    records = spark.createDataFrame([tuple(row)], schema)
    write_reqlog(records, path, schema=schema)
    back = read_reqlog(spark, path, schema)
    assert back.select(*records.columns).collect() == records.collect()


def test_sink_refuses_what_reading_would_lose(spark):
    path = scratch_path(spark, "refused")
    with pytest.raises(ValueError, match="extra"):
        write_reqlog(log_of(spark, record()).withColumn("extra", F.lit(1)), path)
    with pytest.raises(Exception, match="run_id must not be empty"):
        write_reqlog(log_of(spark, record(run="")), path)


def test_sink_splits_a_hot_run(spark):
    """A run too large for one task is written by several."""
    path = scratch_path(spark, "hot")
    hot = spark.range(200_000).selectExpr(
        "id", "'hot' AS run_id", "'main' AS scenario", "id AS user_id", "uuid() AS name",
        "id AS start_ms", "id AS end_ms", "'OK' AS status", "uuid() AS message", "1L AS rt_ms",
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
    try:
        write_reqlog(hot, path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    written = read_reqlog(spark, path)
    assert written.count() == 200_000
    assert written.select(F.input_file_name()).distinct().count() > 1


def test_means_are_finite(spark, skewed):
    assert all(math.isfinite(r.mean_ms) for r in rt_rollup(log_of(spark, *skewed)).collect())


def test_lookups_skip_row_groups(spark):
    """One user in a wide log: the scan gives out fewer rows than the file has, and the same answer."""
    from pyspark.sql import functions as F

    from tallyfield.session import scratch_path
    from tallyfield.sources.reqlog import REQUEST_SCHEMA, read_reqlog, write_reqlog

    # Users are spread, so that bounds alone tell nothing, and too many for a dictionary.
    log = spark.range(200_000).select(
        F.col("id"), F.lit("r").alias("run_id"), (F.xxhash64("id") % 10**12).alias("user_id"), (F.col("id") * 7 % 200_003).alias("start_ms")
    )
    known = {f.split()[0] for f in REQUEST_SCHEMA.split(", ")}
    assert set(log.columns) <= known
    user = log.where("id = 12345").first().user_id

    def scanned(path, condition):
        df = read_reqlog(spark, path).where(condition)
        rows = df.select("id", "start_ms").collect()
        plan = df.select("id", "start_ms")
        plan.write.format("noop").mode("overwrite").save()
        executed = plan._jdf.queryExecution().executedPlan()
        plan._jdf.queryExecution().toRdd().count()
        leaves = executed.collectLeaves()
        return sorted(map(tuple, rows)), leaves.apply(0).metrics().apply("numOutputRows").value()

    small = {"parquet.block.size": str(256 << 10)}
    plain, fast = scratch_path(spark, "log"), scratch_path(spark, "log")
    write_reqlog(log, plain, options=small)
    write_reqlog(log, fast, order=["start_ms"], lookups=["user_id"], options=small)
    for condition in (F.col("user_id") == user, F.col("start_ms").between(1000, 1200)):
        slow_rows, slow_read = scanned(plain, condition)
        fast_rows, fast_read = scanned(fast, condition)
        assert slow_rows == fast_rows and len(fast_rows) > 0
        assert fast_read * 3 < slow_read
