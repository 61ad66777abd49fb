import random

import pytest
from pyspark.sql import functions as F

from tallyfield.operators.exposure import max_exposure
from tallyfield.operators.joins import join_colocated, save_bucketed
from tallyfield.operators.sketches import merge_sketches, rank_error, rt_sketches
from tallyfield.session import scratch_path
from tallyfield.sources.kept import (
    keep_maxima,
    keep_sketches,
    merge_maxima,
    read_maxima,
    read_sketches,
    stream_maxima,
)
from tests.plans import executed_plan

LOG = "run_id string, name string, status string, rt_ms long"
EXPOSURE = "portfolio_id long, site_id long, cov1val double, cov2val double, cov3val double, cov4val double"


def log_rows(seed, runs, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        time = rng.choice([None, int(rng.lognormvariate(6, 1.5)), rng.randint(0, 40)])
        out.append((rng.choice(runs), rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["OK", "KO"]), time))
    return out


def exact(rows, percents):
    out = {}
    for name in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == name]
        times = sorted(r[3] for r in mine if r[3] is not None)
        at = [times[max(0, -(-len(times) * p // 100) - 1)] if times else None for p in percents]
        mean = sum(times) / len(times) if times else None
        out[name] = (len(mine), sum(r[2] == "KO" for r in mine), min(times, default=None), max(times, default=None), mean, *at)
    return out


def kept(df, percents):
    return {
        r.name: (r.requests, r.ko, r.min_ms, r.max_ms, r.mean_ms, *(r[f"p{p}"] for p in percents)) for r in df.collect()
    }


def test_small_sketches_are_exact_run_by_run(spark):
    """Each lot of runs is written on its own, one of them again with other rows."""
    path, percents, rows = scratch_path(spark, "sk"), (1, 50, 95, 100), []
    spoilt = [("r2", "b", "OK", 10**9)] * 5
    for lot in (log_rows(1, ["r1"], 300), spoilt, log_rows(2, ["r2", "r3"], 400)):
        keep_sketches(spark.createDataFrame(lot, LOG), path)
        rows = [r for r in rows if r[0] not in {x[0] for x in lot}] + lot
        got = kept(merge_sketches(read_sketches(spark, path), percents), percents)
        assert got == exact(rows, percents)
    one = merge_sketches(read_sketches(spark, path).where("run_id = 'r1'"), percents)
    assert kept(one, percents) == exact([r for r in rows if r[0] == "r1"], percents)


@pytest.mark.parametrize("size", [256, 1024])
def test_rank_error_of_merged_sketches(spark, size):
    log = spark.range(200_000).select(
        F.concat(F.lit("r"), F.col("id") % 40).alias("run_id"), F.lit("n").alias("name"), F.lit("OK").alias("status"),
        F.exp(F.rand(3) * 14).cast("long").alias("rt_ms"),
    ).cache()
    percents = [1, 10, 50, 75, 95, 99]
    merged = merge_sketches(rt_sketches(log, size=size), percents, size=size).first()
    once = merge_sketches(rt_sketches(log, keys=("name",), size=size), percents, size=size).first()
    for answer in (merged, once):
        for p in percents:
            value = answer[f"p{p}"]
            below, upto = log.agg(F.count(F.when(F.col("rt_ms") < value, 1)), F.count(F.when(F.col("rt_ms") <= value, 1))).first()
            # Three times the bound that 99 of 100 sketches keep.
            slack = 3 * rank_error(size) * 200_000
            assert below - slack <= p / 100 * 200_000 <= upto + slack
    assert merged.requests == once.requests == 200_000 and merged.mean_ms == once.mean_ms
    log.unpersist()


def test_sketches_without_times(spark):
    path = scratch_path(spark, "sk")
    keep_sketches(spark.createDataFrame([("r", "n", "KO", None)] * 3, LOG), path)
    row = merge_sketches(read_sketches(spark, path)).first()
    assert (row.requests, row.ko, row.min_ms, row.mean_ms, row.p50, row.p99) == (3, 3, None, None, None, None)
    keep_sketches(spark.createDataFrame([("s", "n", "OK", 7)], LOG), path)
    assert merge_sketches(read_sketches(spark, path)).first().p50 == 7
    with pytest.raises(Exception, match="run_id must not be empty"):
        keep_sketches(spark.createDataFrame([("", "n", "OK", 7)], LOG), path)


def features(seed, n):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, rng.random() * 100, rng.random(), 5.0])
    return [(rng.choice([1, 2, None]), rng.randint(0, 20), value(), value(), 1.0, 2.0) for _ in range(n)]


def largest(df):
    rows = df.collect()
    assert len({(r.portfolio_id, r.site_id) for r in rows}) == len(rows)
    return {(r.portfolio_id, r.site_id): r.max_10 for r in rows}


def test_maxima_after_each_batch_and_replay(spark):
    path, rows = scratch_path(spark, "mx"), []
    for batch in range(4):
        lot = features(batch, 60)
        rows += lot
        want = largest(max_exposure(spark.createDataFrame(rows, EXPOSURE)))
        for _ in range(2):  # the batch, and the batch again
            keep_maxima(spark.createDataFrame(lot, EXPOSURE), path, f"b{batch}")
            assert largest(read_maxima(spark, path)) == want
        if batch == 1:
            merged = scratch_path(spark, "mx")
            merge_maxima(spark, path, merged)
            path = merged
            assert largest(read_maxima(spark, path)) == want
    keep_maxima(spark.createDataFrame(features(0, 60), EXPOSURE), path, "b0")  # long since merged
    assert largest(read_maxima(spark, path)) == want
    for name in ("", "a/b", "a=b"):
        with pytest.raises(ValueError, match="batch"):
            keep_maxima(spark.createDataFrame(rows, EXPOSURE), path, name)


def test_maxima_of_a_stream(spark):
    source, path, checkpoint = (scratch_path(spark, n) for n in ("src", "mx", "cp"))
    rows = []
    for seed in range(3):
        lot = features(seed, 50)
        rows += lot
        spark.createDataFrame(lot, EXPOSURE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EXPOSURE).option("maxFilesPerTrigger", 1).parquet(source)
        stream_maxima(stream, path, checkpoint).awaitTermination()
        assert largest(read_maxima(spark, path)) == largest(max_exposure(spark.createDataFrame(rows, EXPOSURE)))


def test_buckets_join_without_exchange(spark):
    path = scratch_path(spark, "bk")
    left = spark.range(500).selectExpr("id % 50 AS site", "id AS a")
    right = spark.range(60).selectExpr("CASE WHEN id < 55 THEN id END AS site", "id AS b")
    one = save_bucketed(left, "bucketed_left", f"{path}/l", "site", 4)
    two = save_bucketed(right, "bucketed_right", f"{path}/r", "site", 4)
    joined = join_colocated(one, two, "site")
    plan = executed_plan(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = sorted(map(tuple, left.join(right, "site").select("site", "a", "b").collect()))
    assert sorted(map(tuple, joined.select("site", "a", "b").collect())) == want
    loose = join_colocated(one, right, "site")  # only the side without buckets moves
    assert executed_plan(loose).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, loose.select("site", "a", "b").collect())) == want
