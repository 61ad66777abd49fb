import random

import pytest

from tallyfield.operators.asof import asof_join, running_last
from tests.plans import executed_plan

ROWS = "id int, k string, at long"
CHANGES = "k string, t long, o int, v string, w int"


def brute(rows, changes):
    out = {}
    for i, k, at in rows:
        told = [(t, o is not None, o or 0, v, w) for ck, t, o, v, w in changes if ck == k and t is not None and at is not None and t <= at]
        best = max(told, key=lambda c: c[:3], default=None)
        out[i] = (best[3], best[4], best[0]) if best else (None, None, None)
    return out


def joined(spark, rows, changes, **options):
    df = asof_join(
        spark.createDataFrame(rows, ROWS), spark.createDataFrame(changes, CHANGES), ["k"], "at", "t", ["v", "w"], "o",
        since="since", **options,
    )
    got = {r.id: (r.v, r.w, r.since) for r in df.collect()}
    assert len(got) == len(rows) == df.count()
    return got


@pytest.mark.parametrize(("bits", "levels"), [(21, 2), (3, 2), (2, 3), (4, 1), (5, 0)])
def test_random(spark, bits, levels):
    rng = random.Random(bits)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    rows = [(i, key(), rng.choice([None, rng.randint(-200, 200)])) for i in range(400)]
    order = iter(rng.sample(range(1000), 150))
    changes = [(key(), rng.choice([None, rng.randint(-150, 250)]), next(order), rng.choice(["x", "y", None]), i) for i in range(150)]
    assert joined(spark, rows, changes, bits=bits, levels=levels) == brute(rows, changes)


def test_edges(spark):
    rows = [(1, "k", 10), (2, "k", 9), (3, "none", 10), (4, "k", 2**60), (5, "k", -(2**60)), (6, "n", 7), (7, "o", 5)]
    changes = [("k", 10, 1, "at", 1), ("k", 10, 2, "last", 2), ("k", 50, 1, "z", 3), ("other", 1, 1, "x", 4), ("n", 3, 1, "set", 5), ("n", 7, 1, None, 6)]
    changes += [("o", 5, None, "zz", 7), ("o", 5, 0, "placed", 8)]
    assert joined(spark, rows, changes) == {
        1: ("last", 2, 10), 2: (None, None, None), 3: (None, None, None), 4: ("z", 3, 50), 5: (None, None, None),
        6: (None, 6, 7), 7: ("placed", 8, 5),  # a change to null holds
    }
    assert joined(spark, rows, []) == {r[0]: (None, None, None) for r in rows}
    assert joined(spark, [], changes) == {}


def test_without_an_order_the_largest_values_hold(spark):
    df = asof_join(
        spark.createDataFrame([(1, "k", 5)], ROWS), spark.createDataFrame([("k", 5, 1, "a", 9), ("k", 5, 2, "b", 1)], CHANGES),
        ["k"], "at", "t", ["v"],
    )
    assert [tuple(r) for r in df.collect()] == [(1, "k", 5, "b")]


def test_clashing_columns_are_refused(spark):
    rows = spark.createDataFrame([(1, "k", 5)], ROWS)
    with pytest.raises(ValueError, match="at"):
        asof_join(rows, spark.createDataFrame([], CHANGES), ["k"], "at", "t", ["v"], since="at")


def test_hot_session_is_many_partitions(spark):
    """No window is partitioned by the key alone while there are rows of it."""
    rows = spark.createDataFrame([(i, "hot", i << 21) for i in range(50)], ROWS)
    changes = spark.createDataFrame([("hot", i << 20, i, "v", i) for i in range(50)], CHANGES)
    df = asof_join(rows, changes, ["k"], "at", "t", ["w"])
    assert {r.id: r.w for r in df.collect()} == {i: min(2 * i, 49) for i in range(50)}
    windows = [line for line in executed_plan(df).splitlines() if " Window [" in line or "Window [" in line]
    assert len(windows) >= 2
    assert all("lastblock" in line for line in windows if "_w" not in line and "__at" in line.split("windowspec")[0])


def test_running_last_before(spark):
    cells = spark.createDataFrame([("k", 1, "a"), ("k", 5, None), ("k", 9, "b"), ("k", 20, None)], "k string, at long, v string")
    for levels in (0, 1, 2):
        got = {r.at: r.out for r in running_last(cells, ["k"], "at", "v", "out", True, 2, levels).collect()}
        assert got == {1: None, 5: "a", 9: "a", 20: "b"}
