import random

import pytest

from tallyfield.operators.running import running_peak, running_total


def cells(seed, keys=("a", "b", None), n=120, span=400):
    rng = random.Random(seed)
    return [
        (k, at, rng.randint(-3, 4))
        for k in keys
        for at in rng.sample(range(-span, span), n if k == "a" else n // 4)
    ]


def expected_totals(rows):
    sums, out = {}, []
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        out.append((k, at, v, sums[k]))
    return [(*r, sums[r[0]]) for r in out]


@pytest.mark.parametrize(("bits", "levels"), [(3, 1), (2, 2), (2, 3), (21, 1), (4, 0)])
def test_running_total(spark, bits, levels):
    rows = cells(bits + levels)
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = running_total(df, ["k"], "at", "v", "upto", total="whole", bits=bits, levels=levels)
    assert got.columns == ["k", "at", "v", "upto", "whole"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected_totals(rows), key=repr)


@pytest.mark.parametrize(("bits", "levels"), [(3, 1), (2, 2), (21, 1), (4, 0)])
@pytest.mark.parametrize("keyed", [True, False])
def test_running_peak(spark, bits, levels, keyed):
    rows = cells(7 * bits + levels, keys=("a", "b", None) if keyed else ("a",))
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = running_peak(df, ["k"] if keyed else [], "at", "v", "top", bits, levels).collect()
    tops = {}
    for k, _, _, upto, _ in expected_totals(rows):
        tops[k] = max(tops.get(k, upto), upto)
    assert {(r.k if keyed else "a"): r.top for r in got} == tops


def test_no_keys(spark):
    rows = [(a, v) for _, a, v in cells(11, keys=("a",))]
    df = spark.createDataFrame(rows, "at long, v long")
    got = running_total(df, [], "at", "v", "upto", total="whole", bits=3, levels=2)
    want = [r[1:] for r in expected_totals([("a", *r) for r in rows])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("a", 1, 2, "x"), ("a", 9, 3, "y")], "k string, at long, v long, c string")
    got = running_total(df, ["k"], "at", "v", "upto", bits=2).orderBy("at").collect()
    assert [tuple(r) for r in got] == [("a", 1, 2, "x", 2), ("a", 9, 3, "y", 5)]


def test_no_task_holds_a_hot_key(spark):
    """A hot key of 4,096 rows is cut into blocks of 64, and they spread over the partitions."""
    df = spark.range(4096).selectExpr("'hot' AS k", "id AS at", "1L AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = running_total(df, ["k"], "at", "v", "upto", bits=6)
        sizes = done.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4096
    assert max(sizes) < 4096 / 2
