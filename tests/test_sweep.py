import random

import pytest

from tallyfield.operators.reqlog import scenario_spans
from tallyfield.operators.sweep import max_open, open_requests, open_series

SCHEMA = "run_id string, start_ms long, end_ms long"


def at_instant(spans, t):
    return sum(1 for s, e in spans if s <= t < e)


def brute(spans):
    return {t: at_instant(spans, t) for s in spans for t in s}


@pytest.mark.parametrize("bits", [2, 5, 21])
def test_random_spans(spark, bits):
    rng = random.Random(bits)
    runs = {}
    for _ in range(150):
        start = rng.randint(-100, 300)
        # One run holds most of the spans.
        run = "hot" if rng.random() < 0.6 else rng.choice("abc")
        runs.setdefault(run, []).append((start, start + rng.choice([0, 1, 5, 40])))
    rows = [(r, s, e) for r, spans in runs.items() for s, e in spans]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.run_id, r.at_ms): r.open for r in open_requests(df, bits=bits).collect()}
    assert got == {(r, t): n for r, spans in runs.items() for t, n in brute(spans).items()}
    top = {r.run_id: r.max_open for r in max_open(df, bits=bits).collect()}
    assert top == {r: max(brute(spans).values()) for r, spans in runs.items()}
    together = brute([span for spans in runs.values() for span in spans])
    overall = max_open(df, keys=(), bits=bits, levels=2).collect()
    assert [r.max_open for r in overall] == [max(together.values())]


@pytest.mark.parametrize(
    ("spans", "most"),
    [
        ([(0, 10), (10, 20)], 1),  # touching spans do not overlap
        ([(5, 9), (5, 9), (5, 6)], 3),
        ([(5, 5)], 0),  # nothing is open for no time
        ([(0, 10), (5, None), (None, 7)], 2),  # open to this day; never begun
        ([(0, 4), (1, None), (2, None), (3, None)], 4),
        ([(7, None)], 1),
    ],
)
def test_edges(spark, spans, most):
    df = spark.createDataFrame([("r", *s) for s in spans], SCHEMA)
    assert [r.max_open for r in max_open(df).collect()] == [most]
    assert max(r.open for r in open_requests(df).collect()) == most


def test_last_running_sum_is_zero(spark):
    df = spark.createDataFrame([("r", 3, 8), ("r", 5, 30), ("s", 1, 2)], SCHEMA)
    last = {}
    for r in open_requests(df, bits=2).orderBy("at_ms").collect():
        last[r.run_id] = r.open
    assert last == {"r": 0, "s": 0}


def test_open_spans_count_in_every_run(spark):
    rows = [("r", 0, 5), ("r", 6, None), ("r", 7, None), ("r", 8, None), ("s", 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.run_id: r.max_open for r in max_open(df).collect()} == {"r": 3, "s": 1}
    assert [r.max_open for r in max_open(df, keys=()).collect()] == [4]
    assert {(r.run_id, r.at_ms): r.open for r in open_requests(df).collect()}["r", 8] == 3


def test_nanoseconds(spark):
    """Instants far apart in one run: the top level stays small."""
    day = 86_400 * 10**9
    rows = [("r", i * day, i * day + 3 * day // 2) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.max_open for r in max_open(df).collect()] == [2]


def test_a_part_is_open_while_a_request_is(spark):
    rows = [("r", "m", 1, 0, 5), ("r", "m", 1, 7, None), ("r", "m", 2, 1, 2)]
    log = spark.createDataFrame(rows, "run_id string, scenario string, user_id long, start_ms long, end_ms long")
    spans = {r.user_id: (r.start_ms, r.end_ms, r.length_ms) for r in scenario_spans(log).collect()}
    assert spans == {1: (0, None, None), 2: (1, 2, 1)}
    assert [r.max_open for r in max_open(scenario_spans(log)).collect()] == [2]


def test_no_spans(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert open_requests(df).collect() == []
    assert max_open(df).collect() == []
    assert [r.max_open for r in max_open(df, keys=()).collect()] == [0]


def test_users(spark):
    rows = [("r", "m", 1, 0, 5), ("r", "m", 1, 50, 60), ("r", "m", 2, 20, 30), ("r", "m", 3, 60, 70)]
    log = spark.createDataFrame(rows, "run_id string, scenario string, user_id long, start_ms long, end_ms long")
    assert [r.max_open for r in max_open(scenario_spans(log)).collect()] == [2]


def brute_series(spans, points):
    known = [(s, e) for s, e in spans if s is not None]
    instants = [t for s, e in known for t in (s, e) if t is not None]
    if not instants:
        return {}
    first, last = min(instants), max(instants)
    length, out = last - first + 1, {}
    for t in range(first, last + 1):
        p = (t - first) * points // length
        n = sum(1 for s, e in known if s <= t and (e is None or t < e))
        start, end, peak, area = out.get(p, (t, t, 0, 0))
        out[p] = (start, t + 1, max(peak, n), area + n)
    return out


@pytest.mark.parametrize(("points", "bits"), [(7, 3), (1000, 21), (1, 4), (64, 2)])
def test_series(spark, points, bits):
    rng = random.Random(points)
    runs = {"hot": [], "a": [], "one": [(5, 5)], "open": [(3, None), (9, None)], "far": [(0, 1), (900, 901)], "never": [(None, 4)]}
    for _ in range(120):
        start = rng.randint(-50, 400)
        end = None if rng.random() < 0.05 else start + rng.choice([0, 1, 7, 90])
        runs["hot" if rng.random() < 0.8 else "a"].append((start, end))
    df = spark.createDataFrame([(r, s, e) for r, spans in runs.items() for s, e in spans], SCHEMA)
    rows = open_series(df, points, bits=bits).collect()
    got = {}
    for r in rows:
        assert got.setdefault(r.run_id, {}).setdefault(r.point, r) is r
        assert r.mean_open == r.area / (r.to_ms - r.from_ms)
    want = {r: brute_series(spans, points) for r, spans in runs.items()}
    assert {k: {p: (r.from_ms, r.to_ms, r.peak, r.area) for p, r in v.items()} for k, v in got.items()} == {
        k: v for k, v in want.items() if v
    }


def test_series_of_no_spans(spark):
    assert open_series(spark.createDataFrame([], SCHEMA)).collect() == []


def test_series_peaks_are_the_peak(spark):
    rng = random.Random(9)
    rows = [("r", s := rng.randint(0, 10**9), s + rng.randint(0, 10**7)) for _ in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    series = open_series(df).collect()
    assert len(series) == 1000
    assert max(r.peak for r in series) == max_open(df).first().max_open
    assert sum(r.area for r in series) == sum(e - s for _, s, e in rows)
