import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyfield.llm import conversations, plans
from tallyfield.llm.conversations import auction, passage, repair_conversations, traced
from tests.llm.cases import SF_DIR

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 4:
            role = "user"
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        for _ in range(0 if h == 0 else 2 if h == 3 else 1):
            yield conv, turn, role, text


def cheapest(rows):
    """(cost, audit, repaired) over prefixes: for each written sequence's state the least cost and text."""
    best = {"": (0, "", ())}

    def inserted(table):
        # at most two turns between rows are ever worth their cost
        for _ in range(3):
            for state, (c, a, out) in list(table.items()):
                role = "assistant" if state == "u" else "user"
                offer = (c + 2, a + "I", (*out, f"{role}:"))
                if role[0] not in table or offer[:2] < table[role[0]][:2]:
                    table[role[0]] = offer
        return table

    for role, text, fault in rows:
        after = {}
        for state, (c, a, out) in inserted(dict(best)).items():
            offers = [(state, (c + 3, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    offers.append((role[0], (c + extra, a + "K", (*out, f"{role}:{text}"))))
                new = "assistant" if state == "u" else "user"
                offers.append((new[0], (c + 2 + extra, a + "R", (*out, f"{new}:{text}"))))
            for to, offer in offers:
                if to not in after or offer[:2] < after[to][:2]:
                    after[to] = offer
        best = after
    ends = inserted(dict(best))
    return min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])


def brute(rows, damage=True):
    convs = defaultdict(list)
    for conv, *_ in rows:
        convs[conv]
    for conv, turn, role, text in damaged(rows) if damage else rows:
        convs[conv].append((turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, judged = set(), []
        for _, role, text in turns:
            end = text.strip(BLANK)[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        faults = [f for _, _, f in judged]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(judged)]
        cost, audit, kept = cheapest(judged)
        out[conv] = (
            gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    result = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(result) == len(rows)
    return result


def repaired(spark, rows):
    repair = repair_conversations(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 block", "'x' marks", "2 audit"))
    hashes = {r.conv_id: r.repaired_sha256 for r in repair.hashes().collect()}
    return {r.conv_id: (*(r[c] for c in COLUMNS[:-1]), hashes[r.conv_id]) for r in repair.summary().collect()}, repair


def test_query(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall()
    assert got(plans.op12_conversations(spark, SF_DIR)) == brute(rows)


def mixed_rows(seed, n, conv=0):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "us", None]
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", None, "ünd. ", "Yes."]
    turns = [rng.choice([None, i, i, i // 2]) for i in range(n)]
    # One text to a turn and role, as their order is not the contract's.
    return [(conv, t, rng.choice(roles), f"{rng.choice(texts) or ''} {i if rng.random() < 0.5 else ''}".strip(), ) for i, t in enumerate(turns)]


def without_ties(rows):
    seen = {}
    for r in rows:
        seen.setdefault((r[0], r[1], r[2]), r)
    return [tuple(" " if x is None and i > 1 else x for i, x in enumerate(r)) for r in seen.values()]


@pytest.mark.parametrize("size", [3, 32])
def test_blocks_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", size)
    rows = [r for i in range(60) for r in without_ties(mixed_rows(i, i, None if i == 59 else i))]
    result, repair = repaired(spark, rows)
    assert result == brute(rows, damage=False)
    edits = repair.edits().orderBy("conv_id", "block", "place").collect()
    letters = defaultdict(str)
    for r in edits:
        letters[r.conv_id] += r.edit
    assert dict(letters) == {c: v[6] for c, v in result.items() if v[6]}


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "Fine."), (None, None, "system", "A."),
        (2, None, "user", "a."), (2, None, "user", "a."), (2, None, "user", "a."), (3, 5, "assistant", " "), (4, 7, "tool", "ok."),
        (5, -3, "system", "one."), (5, 2**40, "assistant", "two."),
    ]
    assert repaired(spark, rows)[0] == brute(rows, damage=False)
    assert repaired(spark, [])[0] == {}


def test_one_long_conversation_in_many_tasks(spark):
    """A third of all rows in one conversation, among them many equal ones."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"Own {i}."])) for i in range(4000)]
    rows += [(8, 0, "user", "Same row.")] * 2000 + [(i, i, "user", "Alone.") for i in range(100, 2100)]
    result, repair = repaired(spark, rows)
    assert result == brute(rows, damage=False)
    assert repair.blocks.where("conv_id = 7").select(F.max(F.size("turns"))).first()[0] <= conversations.BLOCK_ROWS


def test_prices_are_costs():
    """The auction against plain shortest paths over all states of small blocks."""
    for n in (1, 2, 3, 5):
        for seed in range(60):
            rng = random.Random(seed)
            marks = bytes(rng.randrange(4) | rng.choice([0, 4, 8, 16, 0]) for _ in range(n))
            arcs = conversations.lattice(marks)
            for leave in range(4):
                cost = {4 * n + s: 0 if s == leave else conversations.FAR for s in range(4)}
                for i in reversed(range(n)):
                    for s in range(4):
                        cost[4 * i + s] = conversations.FAR
                    for _ in range(4):
                        for s in range(4):
                            cost[4 * i + s] = min(
                                [conversations.FAR, *(c + cost[t] for _, c, t in arcs[4 * i + s])]
                            )
                assert [passage(marks)[s][leave] for s in range(4)] == [cost[s] for s in range(4)]


def test_worst_blocks_end_soon():
    blanks = bytes([4] * conversations.BLOCK_ROWS)
    assert passage(blanks)[0][0] == 3 * len(blanks)
    assert traced(blanks, (0, 4, 2, 0), 0) == (0, "D" * len(blanks))
    price = [0, 0, 0, 0, 0, 0, 0, 0, 0]
    arcs = conversations.lattice(b"\x02") + [[("", 0, 8)]] * 4
    assert auction(arcs, price, 0, 8, 99) == 0
