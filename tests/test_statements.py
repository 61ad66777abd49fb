import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallyfield.functions.dates import try_date
from tallyfield.functions.decoding import TABLE_KIND
from tallyfield.functions.matching import full_match
from tallyfield.operators.statements import (
    decode_sessions,
    decode_statements,
    error_match,
    result_match,
    slow_statements,
    statement_times,
)
from tests.plans import executed_plan


def reply(state="available", **output):
    return json.dumps({"id": 7, "state": state, "output": output, "progress": 1.0}, separators=(",", ":"))


ERROR = {"status": "error", "ename": "E", "evalue": "bad\nline", "stackTrace": ["at a", "at b"]}
CASES = {
    "text": (reply(status="ok", data={"text/plain": "hello"}), "ok", "hello"),
    "both": (reply(status="ok", data={"text/plain": "x", TABLE_KIND: {"d": [1, 2]}}), "ok", '{"d":[1,2]}'),
    "no table": (reply(status="ok", data={"text/plain": "x", TABLE_KIND: None}), "ok", "x"),
    "no text": (reply(status="ok", data={"text/plain": None}), "ok", None),
    "neither": (reply(status="ok", data={}), "ok", ""),
    "no data": (reply(status="ok"), "invalid", None),
    "error": (reply(**ERROR), "error", None),
    "no trace": (reply(status="error", ename="E", evalue="v"), "error", None),
    "no status": (reply(data={}), "invalid", None),
    "odd status": (reply(status="odd"), "invalid", None),
    "running": (reply("running"), "pending", None),
    "no state": ('{"id":7}', "pending", None),
    "cut": ('{"id":7,"state":"avail', "invalid", None),
    "not json": ("oops", "invalid", None),
    "empty": ("", "invalid", None),
    "null": (None, "invalid", None),
}


@pytest.fixture(scope="module")
def decoded(spark):
    rows = [(name, case[0]) for name, case in CASES.items()]
    return decode_statements(spark.createDataFrame(rows, "name string, reply string"))


def test_decode(decoded):
    got = {r.name: (r.outcome, r.text) for r in decoded.collect()}
    assert got == {name: case[1:] for name, case in CASES.items()}


def test_error_fields(decoded):
    row = decoded.where("name = 'error'").first()
    assert (row.ename, row.evalue, row.trace) == ("E", "bad\nline", ["at a", "at b"])
    assert decoded.where("outcome <> 'error' AND (ename IS NOT NULL OR trace IS NOT NULL)").count() == 0


@pytest.mark.parametrize(
    ("patterns", "names"),
    [
        ({}, ["error", "no trace"]),
        ({"ename": "E"}, ["error", "no trace"]),
        ({"ename": "e"}, []),
        ({"evalue": "bad.line"}, ["error"]),
        ({"evalue": "bad"}, []),
        ({"trace": ""}, ["no trace"]),
        ({"trace": "at a\nat b", "ename": "E"}, ["error"]),
        ({"trace": "x|at a.*"}, ["error"]),
    ],
)
def test_error_match(decoded, patterns, names):
    assert sorted(r.name for r in error_match(decoded, **patterns).collect()) == names


def test_result_match(decoded):
    assert [r.name for r in result_match(decoded, "hel+o").collect()] == ["text"]


def test_each_reply_is_parsed_once(decoded):
    assert executed_plan(error_match(decoded, evalue="x", trace="y")).count("from_json") == 1


def test_sessions(spark):
    full = {
        "id": 3,
        "appId": "app_1",
        "state": "idle",
        "appInfo": {"driverLogUrl": "/log", "sparkUiUrl": None},
        "log": ["one", "two"],
        "kind": "spark",
    }
    rows = [(json.dumps(full),), ('{"id":4,"state":"dead"}',), ("{",)]
    got = {r.session_id: r for r in decode_sessions(spark.createDataFrame(rows, "reply string")).collect()}
    assert tuple(got[3]) == (3, "app_1", "idle", "/log", None, ["one", "two"])
    assert tuple(got[4]) == (4, None, "dead", None, None, None)
    assert tuple(got[None]) == (None,) * 6


@pytest.mark.parametrize(
    ("text", "pattern", "expected"),
    [
        ("a\nb", "a.b", True),
        ("ab", "a", False),
        ("ab\n", "ab", False),
        ("b", "a|b", True),
        ("xb", "a|b", False),
        (None, ".*", None),
    ],
)
def test_full_match(spark, text, pattern, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(full_match(F.col("t"), pattern).alias("m")).first().m is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2017-01-05", datetime.date(2017, 1, 5)),
        ("2017-13-45", None),
        ("2017-01-05abc", None),
        ("x", None),
        ("", None),
        (None, None),
        ("2017-1-5", None),
        (" 2017-01-05", None),
        ("2017-01-05\n", None),
        ("2017-02-29", None),
        ("2016-02-29", datetime.date(2016, 2, 29)),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(try_date(F.col("t")).alias("d")).first().d == expected


def test_other_date_pattern(spark):
    df = spark.createDataFrame([("05/01/2017",), ("2017-01-05",)], "t string")
    got = [r.d for r in df.select(try_date(F.col("t"), "dd/MM/yyyy").alias("d")).collect()]
    assert got == [datetime.date(2017, 1, 5), None]


def test_statement_times(spark):
    rows = [(1, 0, 2_000_000_000), (1, 0, 1_000_000_000), (2, 5, None)]
    log = spark.createDataFrame(rows, "session_id int, start_ns long, end_ns long")
    got = {r.session_id: tuple(r)[1:] for r in statement_times(log).collect()}
    assert got == {1: (2, 1.5, 2.0), 2: (0, None, None)}


def test_slow_statements(spark):
    second = 10**9
    rows = [("a", 0, 120 * second), ("a", 0, 120 * second + 1), ("b", 5, 6), ("a", 7, None)]
    log = spark.createDataFrame(rows, "session_id string, start_ns long, end_ns long")
    assert {r.session_id: r.over_limit for r in slow_statements(log).collect()} == {"a": 1, "b": 0}
