import random

import pytest

from tallyfield.session import scratch_path
from tallyfield.sources.reqlog import REQUEST_SCHEMA, read_reqlog, stream_reqlog, write_reqlog
from tallyfield.streaming.live import (
    append_metrics,
    late_rows,
    live_metrics,
    read_updates,
    update_metrics,
    update_session,
)


def records(seed, n, first, last):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name, status = rng.choice(["a", "a", "all", "b"]), rng.choice(["OK", "KO"])
        start, rt = rng.randint(first, last), rng.randint(0, 900)
        rows.append((i, "r", "main", 1, name, start, start + rt, status, None, rt, None, None))
    return rows


@pytest.fixture
def source(spark):
    """A folder that grows by one file per call, and the stream over it."""
    folder = scratch_path(spark, "source")

    def add(rows):
        spark.createDataFrame(rows, REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def stream(files=None, session=spark):
        return stream_reqlog(session, folder, files_per_batch=files)

    return add, stream, lambda: read_reqlog(spark, folder)


def rows_of(df):
    columns = ["window_ms", "name", "is_all", "requests", "failed", "max_ms", "mean_ms"]
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("on_disk", [True, False])
def test_updates_over_several_batches_equal_the_batch_answer(spark, source, on_disk):
    add, stream, static = source
    path = scratch_path(spark, "updates")
    for seed in range(3):  # windows get rows from more than one file
        add(records(seed, 120, 0, 20_000))
    session = update_session(spark) if on_disk else spark
    update_metrics(live_metrics(stream(1, session)), f"{path}/m", f"{path}/c").awaitTermination()
    assert len({r.batch for r in spark.read.parquet(f"{path}/m").select("batch").collect()}) >= 3
    assert rows_of(read_updates(spark, f"{path}/m")) == rows_of(live_metrics(static()))


def test_a_stopped_stream_goes_on(spark, source):
    add, stream, static = source
    path, session = scratch_path(spark, "restart"), update_session(spark)
    for seed in range(2):
        add(records(seed, 60, 0, 9_000))
        metrics = live_metrics(stream(session=session))
        update_metrics(metrics, f"{path}/m", f"{path}/c").awaitTermination()
    assert rows_of(read_updates(spark, f"{path}/m")) == rows_of(live_metrics(static()))


def test_complete_mode_equals_batch(spark, source):
    add, stream, static = source
    add(records(9, 80, 0, 30_000))
    query = (
        live_metrics(stream(), "5 seconds")
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("live_complete")
        .option("checkpointLocation", scratch_path(spark, "complete"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows_of(spark.table("live_complete")) == rows_of(live_metrics(static(), "5 seconds"))


def test_append_writes_each_closed_window_once(spark, source):
    add, stream, static = source
    path = scratch_path(spark, "append")
    add(records(4, 80, 0, 30_000))
    query = append_metrics(live_metrics(stream(), delay="5 seconds"), f"{path}/m", f"{path}/c")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    newest = max(r.start_ms for r in static().collect())
    closed = [r for r in rows_of(live_metrics(static())) if r[0] + 1000 <= newest - 5000]
    assert closed
    assert rows_of(spark.read.parquet(f"{path}/m")) == closed


def test_rows_behind_the_delay_are_dropped(spark, source):
    add, stream, static = source
    path = scratch_path(spark, "late")
    on_time, later, late = records(1, 30, 0, 9_000), records(2, 30, 60_000, 69_000), records(3, 5, 0, 900)
    for rows in (on_time, later, late):
        add(rows)
        # A batch drops what is behind the watermark that the batches before it reached.
        metrics = live_metrics(stream(), delay="10 seconds")
        update_metrics(metrics, f"{path}/m", f"{path}/c").awaitTermination()
    kept = spark.createDataFrame(on_time + later, REQUEST_SCHEMA)
    assert rows_of(read_updates(spark, f"{path}/m")) == rows_of(live_metrics(kept))
    assert rows_of(live_metrics(static())) != rows_of(live_metrics(kept))


def test_all_row_is_the_sum_of_the_names(spark, source):
    add, _, static = source
    add(records(2, 100, 0, 5_000))
    sums = {}
    for window, name, is_all, requests, *_ in rows_of(live_metrics(static())):
        assert not is_all or name == "all"
        part = sums.setdefault(window, {True: 0, False: 0})
        part[is_all] += requests
    assert all(p[True] == p[False] for p in sums.values())


def test_a_request_named_all(spark):
    rows = [(1, "r", "main", 1, name, 5, 9, "OK", None, 4, None, None) for name in ("all", "b")]
    got = live_metrics(spark.createDataFrame(rows, REQUEST_SCHEMA)).collect()
    assert sorted((r.name, r.is_all, r.requests) for r in got) == [
        ("all", False, 1), ("all", True, 2), ("b", False, 1)
    ]


def test_totals_only(spark, source):
    add, _, static = source
    add(records(2, 50, 0, 3_000))
    whole = [r for r in rows_of(live_metrics(static())) if r[2]]
    assert rows_of(live_metrics(static(), totals_only=True)) == whole


def test_percentiles_over_several_batches(spark, source):
    add, stream, static = source
    path, percents, accuracy = scratch_path(spark, "percents"), (50, 75, 95, 99), 100
    for seed in range(3):
        add(records(seed, 400, 0, 1_999))
    metrics = live_metrics(stream(1), percents=percents, accuracy=accuracy)
    update_metrics(metrics, f"{path}/m", f"{path}/c").awaitTermination()
    got = read_updates(spark, f"{path}/m", percents).where("is_all").collect()
    times = {}
    for r in static().collect():
        times.setdefault(r.start_ms // 1000 * 1000, []).append(r.rt_ms)
    assert {r.window_ms for r in got} == set(times)
    for r in got:
        values = times[r.window_ms]
        for p in percents:
            found, off = r[f"p{p}"], len(values) / accuracy + 1
            low, high = sum(v < found for v in values), sum(v <= found for v in values)
            assert low - off <= len(values) * p / 100 <= high + off


def test_means_are_exact(spark):
    big = 2**53 + 1
    rows = [(1, "r", "main", 1, "a", 5, 9, "OK", None, t, None, None) for t in (big, 1, 1, -big)]
    got = live_metrics(spark.createDataFrame(rows, REQUEST_SCHEMA), totals_only=True).collect()
    assert [r.mean_ms for r in got] == [0.5]


def test_stream_over_the_sink(spark):
    """The sink's run folders are a source of the stream."""
    path = scratch_path(spark, "sink-stream")
    log = spark.createDataFrame(records(6, 50, 0, 4_000), REQUEST_SCHEMA)
    write_reqlog(log, f"{path}/log")
    stream = live_metrics(stream_reqlog(spark, f"{path}/log"))
    update_metrics(stream, f"{path}/m", f"{path}/c").awaitTermination()
    assert rows_of(read_updates(spark, f"{path}/m")) == rows_of(live_metrics(log))


def test_retried_records_count_once_and_late_ones_are_told(spark, source):
    add, stream, static = source
    path = scratch_path(spark, "once")

    def one(i, at):
        return (i, "r", "main", 1, "a", at, at + 1, "OK", None, 1, None, None)

    first = records(1, 80, 1_000_000, 1_020_000)
    others = [(i + 100, *r) for i, *r in records(2, 40, 1_020_000, 1_030_000)]
    add(first)
    add(first[40:] + others)
    add(others + [one(5000, 1_200_000)])
    # What is late is judged by the watermark of the batch before.
    add([one(5001, 1_200_500)])
    add([one(6000 + i, 1_001_000) for i in range(7)])
    query = append_metrics(live_metrics(stream(1), once=["run_id", "id"]), f"{path}/m", f"{path}/c", every=None)
    query.awaitTermination()
    assert late_rows(query) == 7
    got = rows_of(spark.read.parquet(f"{path}/m"))
    kept = static().where("id < 5000")
    assert kept.count() == 200
    assert got == rows_of(live_metrics(kept, once=["run_id", "id"]))
    assert got == rows_of(live_metrics(kept.dropDuplicates(["run_id", "id"])))
    assert sum(r[3] for r in got if r[2]) == 120
