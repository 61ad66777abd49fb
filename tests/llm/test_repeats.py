import hashlib
import random

import numpy as np
import pytest

from tallyfield.llm import plans, repeats
from tallyfield.llm.repeats import Runs, remove_repeats
from tests.llm.cases import SF_DIR, documents, real_documents, with_clashes


def brute(rows, length=100):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept)} by a table of all strings seen so far."""
    seen, out = set(), {}
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(s)
        cover = np.cumsum(gone)[: len(data)] > 0
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
        out[doc, text] = (len(data), int(cover.sum()), spans, kept)
    return out


def check(df, rows, length=100):
    want = brute(rows, length)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) == want[r.doc_id, r.text], r.doc_id


def test_query(spark):
    rows = [r[:2] for r in real_documents()]
    want = brute(rows)
    assert sum(v[1] for v in want.values()) > 0
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in plans.op11_repeats(spark, SF_DIR).collect()}
    assert got == {d: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for (d, _), v in want.items()}


@pytest.mark.parametrize("length", [8, 40, 100])
def test_shared_passages(spark, length):
    rng = random.Random(length)
    words = ["ab", "ba", "ü", "x y", "\n", "ß!", "aaaa"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(5)]
    rows = [(i, text(rng.randint(0, 80)) + rng.choice(shared) + text(9) + rng.choice(shared)) for i in range(120)]
    rng.shuffle(rows)
    check(remove_repeats(documents(spark, rows), length=length), rows, length)


def test_common_anchors_go_one_by_one(spark, monkeypatch):
    """One passage in all texts, each time in other surroundings."""
    monkeypatch.setattr(repeats, "COMMON", 3)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 400)
    monkeypatch.setattr(repeats, "RUNS_KNOWN", 5)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(130))
    rows = [(i, f"{rng.random()} own {passage[rng.randint(0, 20) :]} end {rng.random()}") for i in range(150)]
    rows += [(i, "copy of a text that is long enough to hold more than one hundred bytes in all, which it does by now, or not? " * 2) for i in range(200, 260)]
    check(remove_repeats(documents(spark, rows)), rows)


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdefghijklmnop") for _ in range(1_200_000))
    rows = [
        (1, None), (2, ""), (3, "short"), (None, "n" * 99), (4, "a" * 5000), (5, "b" * 100), (5, "b" * 100), (6, "b" * 100),
        (6, "x" + "b" * 101), (None, "same null id " * 20), (7, "é" * 130), (8, "x" + "é" * 130), (9, long), (10, long[500_000:] + "tail"),
        (-3, "negative ids come first " * 9), (11, "negative ids come first " * 9),
    ]
    df = with_clashes(documents(spark, rows)).selectExpr("*", "1 kept_", "2 _doc", "3 doc", "4 mark", "5 spans", "6 n_bytes", "7 _text")
    out = remove_repeats(df)
    assert set(df.columns) <= set(out.columns)
    assert {tuple(r) for r in out.select("_doc", "doc", "mark", "spans", "_text", "score").collect()} == {(2, 3, 4, 5, 7, "x")}
    check(out, rows)
    assert remove_repeats(documents(spark, [])).count() == 0


def test_equal_strings_have_equal_anchors():
    rng = random.Random(4)
    for _ in range(30):
        s = bytes(rng.randrange(97, 100) for _ in range(140))
        a, b = Runs([b"pq" + s + b"r"], 100), Runs([b"x" * 57 + s], 100)
        at = {}
        for runs, shift in ((a, 2), (b, 57)):
            for first, n, h in zip(runs.first.tolist(), runs.size.tolist(), runs.hash.tolist(), strict=True):
                for i in range(first, first + n):
                    if 0 <= i - shift <= 40:
                        assert at.setdefault(i - shift, h) == h
        assert len(at) == 41
    assert Runs([b"a" * 99, b"", b"a" * 300], 100).size.sum() == 201
