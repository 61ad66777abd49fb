import random

import pytest

from tallyfield.operators.cells import cell_percentiles, relative_error, rt_cells

LOG = "run_id string, name string, rt_ms long"


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_error_is_within_the_bound(spark, bits):
    rng = random.Random(bits)
    rows = [("r", rng.choice(["skewed", "skewed", "skewed", "few"]), int(rng.lognormvariate(5, 3))) for _ in range(3000)]
    rows += [("s", "flat", 7)] * 50 + [("s", "wide", 2**62 + i) for i in range(9)] + [("s", "one", 0), (None, None, 12)]
    rows += [("s", "below", -(3**i)) for i in range(20)]
    percents = [0.5, 1, 25, 50, 75, 99, 99.9, 100]
    cells = rt_cells(spark.createDataFrame(rows, LOG), ["run_id", "name"], bits)
    got = {r.name: r for r in cell_percentiles(cells, percents).collect()}
    times = {}
    for _, name, rt in rows:
        times.setdefault(name, []).append(rt)
    assert set(got) == set(times)
    for name, known in times.items():
        known.sort()
        assert got[name].requests == len(known)
        for p in percents:
            rank = max(1, -(-len(known) * int(p * 10) // 1000))
            value, true = got[name][f"p{p:g}".replace(".", "_")], known[rank - 1]
            assert abs(value - true) <= relative_error(bits) * abs(true)


def test_cells_are_few_and_add_up(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 3}", "n", rng.randint(0, 2**20)) for i in range(5000)]
    log = spark.createDataFrame(rows, LOG)
    cells = rt_cells(log, ["name"])
    assert cells.count() <= 32 * 16 + 32
    parts = rt_cells(log.where("run_id = 'r0'"), ["name"]).union(rt_cells(log.where("run_id <> 'r0'"), ["name"]))
    assert cell_percentiles(parts).collect() == cell_percentiles(cells).collect()
    for r in cells.collect():
        here = [t for _, _, t in rows if r.cell_ms <= t < r.cell_ms + r.width_ms]
        assert len(here) == r.requests


def test_no_times(spark):
    assert cell_percentiles(rt_cells(spark.createDataFrame([("r", "n", None)], LOG))).collect() == []
