import hashlib
import zlib
from collections import Counter

from tallyfield.llm import plans
from tallyfield.llm.shards import PLACES, assign_shards, ring, spread
from tests.llm.cases import SF_DIR, documents, real_documents, with_clashes


def place(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:8], 16) % PLACES


def brute(places, shards):
    """How many rows of each place each shard has, row by row: own nodes first, then clockwise."""
    nodes = ring(shards)
    room = [len(places) // shards + (s < len(places) % shards) for s in range(shards)]
    got, waiting = Counter(), []
    for p in sorted(places):
        at = next((i for i, (q, _) in enumerate(nodes) if q >= p), 0)
        s = nodes[at][1]
        if room[s]:
            room[s] -= 1
            got[p, s] += 1
        else:
            waiting.append((p, at))
    for p, at in waiting:
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        got[p, nodes[at][1]] += 1
    return got


def check(rows, shards):
    sizes = Counter(r.shard for r in rows)
    assert not rows or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert Counter((place(r.doc_id), r.shard) for r in rows) == brute([place(r.doc_id) for r in rows], shards)


def test_hot_keys_and_odd_rows(spark):
    rows = [(i, None) for i in range(300)] + [(7, "same")] * 200 + [(None, "")] * 100
    got = assign_shards(with_clashes(documents(spark, rows)), shards=5).collect()
    assert len(got) == len(rows)
    check(got, 5)
    assert assign_shards(documents(spark, [])).count() == 0
    check(assign_shards(documents(spark, rows[:3])).collect(), 16)


def test_query(spark):
    got = plans.op9_shards(spark, SF_DIR).collect()
    check(got, 16)
    docs = {d: t or "" for d, t, *_ in real_documents()}
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()))
        assert (r.law, r.grown_shard) == ("rows", None)


def test_growth_moves_few_rows():
    counts = {p: 50 for p in range(PLACES)}

    def owners(shards):
        out = {}
        for p, a, b, s, _ in spread(counts, shards):
            out.update({(p, k): s for k in range(a, b)})
        return out

    old, new = owners(16), owners(17)
    assert len(old) == 50 * PLACES
    assert sum(old[k] != new[k] for k in old) / len(old) < 0.35
