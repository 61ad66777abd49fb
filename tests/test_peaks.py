import random

import pytest

from tallyfield.operators.sweep import max_open
from tallyfield.session import scratch_path
from tallyfield.sources.reqlog import REQUEST_SCHEMA, stream_reqlog
from tallyfield.streaming.peaks import add_changes, read_peaks, settle, stream_changes

SCHEMA = "run_id string, start_ms long, end_ms long"


def spans(seed, n, first, last):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        start = rng.randint(first, last)
        run = rng.choice(["hot", "hot", "hot", "a", None])
        rows.append((run, start, None if rng.random() < 0.1 else start + rng.choice([0, 1, 5, 60])))
    return rows


def want(spark, rows):
    top = {r.run_id: r.max_open for r in max_open(spark.createDataFrame(rows, SCHEMA)).collect()}
    return {run: (top[run], sum(1 for r, s, e in rows if r == run and e is None), 0) for run in top}


def got(spark, path, bits):
    rows = read_peaks(spark, path, bits).collect()
    assert len({r.run_id for r in rows}) == len(rows)
    return {r.run_id: (r.max_open, r.open_now, r.late) for r in rows}


@pytest.mark.parametrize("bits", [3, 6])
def test_batches_replays_and_settling(spark, bits):
    path, rows = scratch_path(spark, "pk"), []
    for batch in range(4):
        lot = spans(batch, 60, batch * 100, batch * 100 + 250)
        rows += lot
        for _ in range(2):  # the batch, and the batch again
            add_changes(spark.createDataFrame(lot, SCHEMA), path, str(batch))
        assert got(spark, path, bits) == want(spark, rows)
        if batch in (1, 2):
            later = scratch_path(spark, "pk")
            settle(spark, path, later, (batch + 1) * 100, bits)  # all that comes next starts later
            path = later
            assert got(spark, path, bits) == want(spark, rows)
            settled = spark.read.parquet(path).where("settled")
            assert settled.count() == settled.select("run_id", "at_ms").distinct().count() > 0
            assert settled.where(f"last_ms >= {(batch + 1) * 100}").count() == 0


def test_late_changes_are_counted_and_later_levels_are_right(spark):
    path, later = scratch_path(spark, "pk"), scratch_path(spark, "pk")
    add_changes(spark.createDataFrame([("r", 1, 3), ("r", 2, 90)], SCHEMA), path, "0")
    settle(spark, path, later, 16, 3)
    add_changes(spark.createDataFrame([("r", 4, 40), ("r", 5, 6), ("r", 30, 95)], SCHEMA), later, "1")
    # 2, 4 and 30 are open at 30; one start and one whole span came late, in a block that was settled.
    assert got(spark, later, 3) == {"r": (3, 0, 3)}
    again = scratch_path(spark, "pk")
    settle(spark, later, again, 64, 3)
    assert got(spark, again, 3) == {"r": (3, 0, 3)}


def test_stream_equals_the_batch_answer(spark):
    source, path, checkpoint = (scratch_path(spark, n) for n in ("src", "pk", "cp"))
    rows = []
    for seed in range(3):
        lot = spans(seed, 80, 0, 400)
        rows += lot
        full = [(i, r, "m", 1, "n", s, e, "OK", None, None, None, None) for i, (r, s, e) in enumerate(lot)]
        spark.createDataFrame(full, REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream_changes(stream_reqlog(spark, source, files_per_batch=1), path, checkpoint).awaitTermination()
        assert got(spark, path, 21) == want(spark, rows)
    assert spark.read.parquet(path).select("batch").distinct().count() == 3
