import random
import re
from collections import Counter, defaultdict

import pytest

from tallyfield.operators.messages import message_templates

LOG = "run_id string, status string, message string"


def brute(rows, depth, children):
    split = [(run, m, re.split("[ \t\r\n]+", re.sub("[0-9]+", "<*>", m))) for run, s, m in rows if s == "KO" and m is not None]
    nodes = [(len(t),) for *_, t in split]
    for level in range(depth):
        below = defaultdict(set)
        for node, (*_, t) in zip(nodes, split, strict=True):
            below[node].add(t[level] if level < len(t) else "")
        for k, (*_, t) in enumerate(split):
            if len(below[nodes[k]]) > children:
                t[level] = "<*>"
            nodes[k] += (t[level] if level < len(t) else "",)
    at = defaultdict(set)
    for node, (*_, t) in zip(nodes, split, strict=True):
        for i, x in enumerate(t):
            at[node, i].add(x)
    failures, messages = Counter(), defaultdict(set)
    for node, (run, m, t) in zip(nodes, split, strict=True):
        found = run, " ".join("<*>" if len(at[node, i]) > children else x for i, x in enumerate(t))
        failures[found] += 1
        messages[found].add(re.sub("[0-9]+", "<*>", m))
    nulls = Counter(run for run, s, m in rows if s == "KO" and m is None)
    rest = [(run, None, n, 0) for run, n in nulls.items()]
    return sorted([(*f, n, len(messages[f])) for f, n in failures.items()] + rest, key=repr)


@pytest.mark.parametrize("depth,children", [(0, 3), (1, 2), (2, 3), (3, 8)])
def test_against_brute_force(spark, depth, children):
    rng = random.Random(depth)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    made = [
        lambda: f"connection to {word(3)}:{rng.randrange(9999)} refused",
        lambda: f"user {word(4)} not found in {rng.choice(['eu', 'us'])}",
        lambda: f"{word(5)} timed out after {rng.randrange(90)} ms",
        lambda: f"status.find.in({rng.randrange(200, 209)}),\tfound {rng.choice([404, 500])}",
        lambda: rng.choice(["", " ", "one", "x" * 5000 + " y", None]),
    ]
    rows = [("hot" if i % 3 else f"r{i % 4}", rng.choice(["KO", "KO", "OK"]), rng.choice(made)()) for i in range(900)]
    rows += rows[:50]
    got = message_templates(spark.createDataFrame(rows, LOG).repartition(7), ["run_id"], depth=depth, children=children)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, depth, children)


def test_many_messages_are_few_templates(spark):
    rows = [("r", "KO", f"order {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} of user {i} failed") for i in range(2000)]
    got = message_templates(spark.createDataFrame(rows, LOG)).collect()
    assert [tuple(r) for r in got] == [("order <*> of user <*> failed", 2000, 676)]


def test_no_failures(spark):
    assert message_templates(spark.createDataFrame([("r", "OK", "m")], LOG)).collect() == []
