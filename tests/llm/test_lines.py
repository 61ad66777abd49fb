import hashlib
from collections import Counter

import numpy as np

from tallyfield.llm import plans
from tallyfield.llm.bloom import Filter, OnceTwice
from tallyfield.llm.lines import drop_common_lines
from tests.compare import duck, duck_rows, spark_rows
from tests.llm.cases import SF_DIR, documents, lowered, with_clashes

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, least=10):
    """(n_lines, n_dropped, text) for each text."""
    keyed = [[(lowered(line.strip(BLANK)), line) for line in (t or "").split("\n")] for t in rows]
    found = Counter(k for lines in keyed for k in {k for k, _ in lines if k})
    out = []
    for lines in keyed:
        kept = [line for k, line in lines if not k or found[k] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_odd_rows(spark):
    texts = [f" Common line\t\nown {i}\n\n" for i in range(9)] + ["COMMON LINE\x0b", None, "", "\n\n", "x\r\ncommon Line"]
    texts += ["common line"] * 12 + ["ÄÖ"] * 9 + ["äö"] * 5 + ["y" * 300_000, "twice\ntwice\ntwice"] * 2
    texts += ["near\n" * 30] * 9
    df = with_clashes(documents(spark, [(i % 40 or None, t) for i, t in enumerate(texts)]))
    got = drop_common_lines(df.withColumn("nr", df.n_chars)).collect()
    assert len(got) == len(texts)
    want = Counter((a, b, t) for a, b, t in brute(texts))
    assert Counter((r.n_lines, r.n_dropped, r.text) for r in got) == want
    assert drop_common_lines(documents(spark, [])).count() == 0


def test_first_stays(spark):
    rows = [(i, f"shared\nown {i}\nshared") for i in range(12)]
    got = {r.doc_id: r.text for r in drop_common_lines(documents(spark, rows), keep_first=True).collect()}
    assert got[0] == "shared\nown 0" and got[11] == "own 11"


def test_filters_miss_nothing():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    seen, parts = Counter(), []
    for _ in range(3):
        part = OnceTwice(1 << 16)
        for _ in range(5):
            doc = np.unique(rng.choice(pool, 20))
            seen.update(doc.tolist())
            part.add(doc)
        parts.append(part)
    once, twice = np.zeros(8192, np.uint8), np.zeros(8192, np.uint8)
    for p in parts:
        twice |= p.twice.data | (once & p.once.data)
        once |= p.once.data
    both = np.array([h for h, n in seen.items() if n > 1], np.uint64)
    single = np.array([h for h, n in seen.items() if n == 1], np.uint64)
    assert Filter(1 << 16, twice).has(both).all()
    assert Filter(1 << 16, twice).has(single).mean() < 0.2


def test_filters_leave_a_task_in_small_batches():
    """Filters of some MB are not copied whole, and no chunk is lost."""
    part = OnceTwice(1 << 26)
    hashes = np.random.default_rng(4).integers(0, 2**63, 60_000).astype(np.uint64)
    part.add(hashes)
    part.add(hashes[:30_000])
    batches = list(part.chunks())
    assert len(batches) > 1 and max(b.nbytes for b in batches) < 6_000_000
    for name, whole in (("once", part.once.data), ("twice", part.twice.data)):
        data = np.zeros_like(whole).reshape(-1, 8192)
        for b in batches:
            for i, chunk in zip(b["chunk"].to_pylist(), b[name].to_pylist(), strict=True):
                data[i] = np.frombuffer(chunk, np.uint8)
        assert (data.ravel() == whole).all()
    assert [b.num_rows for b in OnceTwice(1 << 16).chunks()] == [0]


def test_query(spark):
    names, want = duck_rows(duck(SF_DIR), plans.ORACLES["op7_line_dedup"])
    df = plans.op7_line_dedup(spark, SF_DIR)
    assert sorted(df.columns) == names
    assert spark_rows(df) == want
    assert hashlib.sha256(b"").hexdigest() not in {None}
