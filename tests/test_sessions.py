import random

import pytest

from tallyfield.operators.sessions import (
    active_positions,
    active_sessions,
    first_active,
)
from tallyfield.operators.statements import decode_session_lists
from tests.plans import executed_plan

SCHEMA = "cluster string, position long, id long, state string"


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [
        ("a", 1, 11, "dead"),
        ("a", 2, 14, "IDLE"),
        ("a", 3, 12, "Running"),
        ("a", 4, 13, "starting"),
        ("a", 5, 15, None),
        ("b", 1, 21, "busy"),
        ("b", 2, 22, "error"),
        ("b", 3, 23, "shutting_down"),
        (None, 1, 31, "idle"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_active(sessions):
    assert sorted(r.id for r in active_sessions(sessions).collect()) == [12, 13, 14, 31]


def test_first(sessions):
    got = {r.cluster: r.first_active_id for r in first_active(sessions, ["cluster"]).collect()}
    assert got == {"a": 14, "b": 0, None: 31}


def ranked(df, **named):
    return {(r.cluster, r["rank"]): r.session_id for r in active_positions(df, ["cluster"], **named).collect()}


def test_ranks(sessions):
    assert ranked(sessions) == {("a", 1): 13, ("a", 2): 12, ("a", 3): 14, (None, 1): 31}


def test_no_place_and_no_id(spark):
    rows = [
        ("a", None, 5, "idle"), ("a", 9, 6, "idle"), ("a", 1, 4, "dead"),  # 5 stands at place 5
        ("b", None, 8, "idle"),
        ("c", 1, None, "idle"), ("c", 2, 3, "idle"),
        ("d", 1, None, "idle"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    first = {r.cluster: r.first_active_id for r in first_active(df, ["cluster"]).collect()}
    assert first == {"a": 5, "b": 8, "c": 3, "d": 0}
    assert ranked(df) == {("a", 1): 6, ("a", 2): 5, ("b", 1): 8, ("c", 1): 3}


def test_listed_sessions_keep_their_place(spark):
    listing = (
        '{"from":0,"total":3,"sessions":[{"id":5,"state":"dead"},{"id":9,"state":"Idle","x":1},'
        '{"id":7,"state":"running"}]}'
    )
    rows = [("a", listing), ("b", '{"from":0,"total":0,"sessions":[]}'), ("c", "oops")]
    df = decode_session_lists(spark.createDataFrame(rows, "cluster string, reply string"))
    assert [(r.cluster, r.position, r.session_id) for r in df.collect()] == [
        ("a", 0, 5), ("a", 1, 9), ("a", 2, 7)
    ]
    first = first_active(df, ["cluster"], session_id="session_id").collect()
    assert [r.first_active_id for r in first] == [9]
    assert ranked(df, session_id="session_id") == {("a", 1): 7, ("a", 2): 9}


def test_first_without_a_group_key(sessions):
    one = sessions.where("cluster = 'a'")
    assert [r.first_active_id for r in first_active(one, []).collect()] == [14]


@pytest.mark.parametrize("bits", [2, 21])
def test_hot_group(spark, bits):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot", "hot", "c", "d"]), at, 1000 - at, rng.choice(["idle", "dead", "Running"]))
        for at in range(200)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = {}
    for c, _, i, s in sorted(rows, key=lambda r: -r[1]):
        lists.setdefault(c, []).extend([i] if s != "dead" else [])
    got = active_positions(df, ["cluster"], bits=bits)
    assert ranked(df, bits=bits) == {(c, n): i for c, ids in lists.items() for n, i in enumerate(ids, 1)}
    assert "collect_list" not in executed_plan(got)


def test_places_may_be_any_bigint(spark):
    places = [-(2**62), -5, 0, 7, 2**40, 2**62]
    rows = [("a", at, n, "idle") for n, at in enumerate(places)]
    got = active_positions(spark.createDataFrame(rows, SCHEMA), ["cluster"]).orderBy("rank").collect()
    assert [(r["rank"], r.session_id) for r in got] == [(n + 1, 5 - n) for n in range(6)]
