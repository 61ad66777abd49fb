import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfield.llm import plans, spelling
from tallyfield.llm.spelling import Trie, group_counts, one_apart, spelling_variants
from tests.llm.cases import SF_DIR, documents, lowered, real_documents, with_clashes


def brute_words(rows, damage=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute(rows, damage=True):
    words = brute_words(rows, damage)
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    for w in words:
        for i in range(len(w)):
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query(spark):
    assert got(plans.op13_spelling(spark, SF_DIR)) == brute([r[:2] for r in real_documents()])


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 7)
    monkeypatch.setattr(spelling, "TASK_WORDS", 40)
    monkeypatch.setattr(spelling, "BATCH", 11)


def test_anagrams_and_split_cells(spark, small_cells):
    """One cell with all the words, many of them made of the same letters."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(500)}
    rows = [(i, " ".join([w] * rng.randint(1, 9))) for i, w in enumerate(sorted(words))]
    assert got(spelling_variants(documents(spark, rows))) == brute(rows, damage=False)


def test_odd_rows(spark):
    long = "x" * 3_000
    rows = [
        (1, None), (2, ""), (3, "  \n "), (4, "Ünïcode Ünïcode ünïcode Ünïcode"), (None, "naïve naïve naive naive naive"),
        (5, f"{long} {long} {long}y {long}y"), (5, f"{long} {long}y"), (6, "abcd abcd abcd abcde abcde abcde"),
        (7, "don't stop-word straße Straße strasse strasse strasse strase strase strase strase strase strase strase"),
        (8, "chain1 chain2 ×÷×÷× ×÷×÷× ×÷×÷×"), (9, "tied tieda tieda tieda tiedb tiedb tiedb tiedc tiedc tiedc"),
    ]
    rows += [(9, "same row here again") for _ in range(4)]
    df = with_clashes(documents(spark, rows)).selectExpr("*", "1 word", "2 n", "3 form", "4 root", "5 up")
    for damage in (True, False):
        assert got(spelling_variants(df, damage=damage)) == brute(rows, damage)
    assert got(spelling_variants(documents(spark, []))) == set()
    assert got(spelling_variants(documents(spark, [(1, None)]))) == set()


def test_very_long_words(spark):
    long = "xy" * 100_000
    rows = [(1, f"{long} {long} {long}"), (2, f"{long}z " * 9 + "other " * 3)]
    assert got(spelling_variants(documents(spark, rows))) == {
        (long, f"{long}z", f"{long}z", 3, 1, 9), (f"{long}z", None, f"{long}z", 9, 1, None), ("other", None, "other", 3, 0, None)
    }


def test_long_chain_of_forms(spark):
    rows = [(i, " ".join(["abcde" + "f" * i] * 3 * 2**i)) for i in range(9)]
    result = got(spelling_variants(documents(spark, rows)))
    assert result == brute(rows, damage=False)
    assert {r[2] for r in result} == {"abcde" + "f" * 8}


def test_trie_meets_each_pair_once_each_way():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(5)).encode() for _ in range(3000)})
    group = np.arange(256) % 16
    trie = Trie(np.zeros(len(words), np.int64), words, np.ones(len(words), np.int64), group)
    both = np.full(len(words), spelling.ALL, np.int64)
    q, w = trie.search(np.zeros(len(words), np.int64), group_counts(words, group), both, both)
    assert len({*zip(q.tolist(), w.tolist(), strict=True)}) == len(q)
    near = spelling.verified(words, trie.words, q, w)
    found = {(words[a], trie.words[b]) for a, b in zip(q[near], w[near], strict=True)}
    # Changes within one coarse group; others are met in other cells.
    same = group // 4
    for a in words[:200]:
        for b in words:
            if one_apart(a, b) and sorted(same[list(a)]) == sorted(same[list(b)]):
                assert (a, b) in found
    assert all(one_apart(a, b) for a, b in found)


def test_one_apart():
    for a, b, want in [("abc", "abd", 1), ("abc", "ab", 1), ("abc", "xabc", 1), ("abc", "abc", 0), ("abc", "acb", 0), ("a", "", 1)]:
        assert one_apart(a.encode(), b.encode()) == bool(want) == one_apart(b.encode(), a.encode())
