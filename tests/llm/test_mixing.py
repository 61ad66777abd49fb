import math
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tallyfield.llm import mixing, plans
from tallyfield.llm.mixing import score_documents
from tests.llm.cases import SF_DIR, documents, real_documents


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def check_base(rows, got):
    train = Counter()
    for key, text in rows:
        if zlib.crc32(("" if key is None else str(key)).encode()) % 7 != 2:
            train.update(tokens(text))
    n, v = sum(train.values()), len(train)
    want = sorted(
        (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), 4))
        for _, t in rows
    )
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_query(spark):
    got = plans.op1_lm_scores(spark, SF_DIR).collect()
    check_base([(d, t) for d, t, *_ in real_documents()], got)
    assert all(r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert sum(r.bits_per_byte for r in got) / len(got) < 4  # far from 8 bits


def test_blocks_of_coders():
    rng = np.random.default_rng(3)
    coders = np.log10(rng.dirichlet(np.ones(20), 3))
    ids = [rng.integers(0, 20, n) for n in (0, 5, mixing.BLOCK, 100, 1, 0)]
    for got, doc in zip(mixing.adapted(ids, coders), ids, strict=True):
        weights, want = np.ones(3) / 3, 0.0
        for i, at in enumerate(doc):
            each = weights * 10 ** coders[:, at]
            want += math.log10(each.sum())
            weights = each / each.sum()
            if i % mixing.BLOCK == mixing.BLOCK - 1:
                weights = weights * (1 - mixing.SWITCH) + mixing.SWITCH / 3
        assert abs(got - want) < 1e-9


def test_probabilities_of_one_word_sum_to_at_most_one(spark):
    """Over every one-word text, known or not, with tables of classes and words outside the table."""
    rows = [(i, "ab b" if i % 2 else "a ba a", str(i % 2)) for i in range(30)]
    letters = [""] + ["".join(w) for n in (1, 2, 3) for w in product("abc", repeat=n)]
    kept, mixing.FREQUENT = mixing.FREQUENT, 2
    try:
        held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
        rows += [(held, w, None) for w in letters]
        got = mixing.score_documents(documents(spark, rows).select("doc_id", "text", "lang"), classes="lang")
        scores = [r.score for r in got.collect() if r.doc_id == held]
    finally:
        mixing.FREQUENT = kept
    assert len(scores) == len(letters) and 0.1 < sum(10**s for s in scores) <= 1


def test_classes_raise_the_score_of_held_out_texts(spark):
    """Two kinds of text with words of their own; the kind of the held-out texts is not given."""
    rng = np.random.default_rng(5)
    kinds = ["one two three four five six".split(), "un deux trois quatre cinq sept".split()]
    rows = []
    for i in range(200):
        held = zlib.crc32(str(i).encode()) % 7 == 2
        rows.append((i, " ".join(rng.choice(kinds[i % 2], 40)), None if held else str(i % 2)))
    docs = documents(spark, rows).select("doc_id", "text", "lang")
    got = [r for r in mixing.score_documents(docs, classes="lang").collect() if r.held_out]
    assert len(got) > 10 and all(r.score > r.base_score + 5 for r in got)


def test_bits_of_a_text_look_over_word_boundaries(spark):
    """Words in the order of the training texts cost less than the same words, of equal counts, in another."""
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "quick brown foxes jump " * 8) for i in range(300) if i not in held]
    texts = ["quick brown foxes jump " * 4, "jump foxes brown quick " * 4]
    rows += [(i, texts[n % 2]) for n, i in enumerate(held)]
    got = {r.doc_id: r for r in score_documents(documents(spark, rows).select("doc_id", "text")).collect()}
    for same, other in (held[:2], held[2:]):
        assert abs(got[same].base_score - got[other].base_score) < 1e-9
        assert got[same].score > got[other].score + 3


def test_tables_and_mixed_bits_against_plain_loops(spark):
    texts = ["ab ba abc", "b" * 30 + " ab ab", "é \x00 ab", "", None, "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = mixing.fit_tables(docs, "text")
    rng = np.random.default_rng(1)
    model.weights = rng.normal(0.3, 0.2, model.weights.shape).astype(np.float32)
    model.map = rng.random((mixing.GATES, mixing.STEPS)) * 0.9 + 0.05

    def steps(before, word):
        """(contexts, place, bits of the byte so far, bit) of all bits, spelled out."""
        before, coded = before[-mixing.BEFORE :] + b" ", word + b" "
        for i, byte in enumerate(coded):
            seen = before + coded[:i]
            orders = [(k, seen[-k:]) for k in mixing.ORDERS]
            for place in range(8):
                so_far = (1 << place) | byte >> (8 - place)
                yield [*orders, ("word", coded[:i]), ("before", before, coded[:i])], place, so_far, byte >> (7 - place) & 1

    counts = [Counter() for _ in range(mixing.KINDS)]
    known = [t.encode().lower().split() for t in texts if t]
    for words in known:
        for before, word in zip([b"", *words], words):
            for contexts, _, so_far, bit in steps(before, word):
                for k, context in enumerate(contexts):
                    counts[k][context, so_far, bit] += 1

    def plain(before, word):
        total = 0.0
        for contexts, place, so_far, bit in steps(before, word):
            x, sure = [], []
            for k, context in enumerate(contexts):
                zeros, ones = counts[k][context, so_far, 0], counts[k][context, so_far, 1]
                x.append(int(np.clip(math.log((ones + 0.05) / (zeros + 0.05)) * 16, -127, 127)) / 16)
                sure.append(min(math.ceil(math.log2(zeros + ones + 1)), mixing.SURE - 1))
            gate = (place * mixing.SURE + sure[-2]) * mixing.SURE + sure[-1]
            z = float(np.clip(sum(a * float(b) for a, b in zip(x, model.weights[gate], strict=True)), -12, 12))
            at = round((min(max(z, -8), 8) + 8) * (mixing.STEPS - 1) / 16)
            p = (1 / (1 + math.exp(-z)) + model.map[gate, at]) / 2
            total += math.log10(p if bit else 1 - p)
        return total

    pairs = [(b"", b"ab"), (b"ab", b"ba"), (b"ba", b"abc"), (b"b" * 30, b"ab"), (b"ab", b"zz"), (b"zz", b"b" * 30), ("é".encode(), b"\0")]
    got = model.log10([mixing.pairs_of([a, b])[1] for a, b in pairs])
    for value, pair in zip(got, pairs, strict=True):
        assert abs(value - plain(*pair)) < 0.02 * abs(plain(*pair)), pair


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat " * 5) for i in range(20)] + [(21, None), (22, ""), (None, "the cat"), (3, "x" * 50_000), (3, "x" * 50_000)]
    got = score_documents(documents(spark, rows).select("doc_id", "text")).collect()
    check_base(rows, got)
    assert score_documents(documents(spark, []).select("doc_id", "text")).count() == 0


def test_half_bytes_are_looked_up_at_once():
    """One lookup gives the inputs of four bits: those at the nodes on the way to the half byte, and its gates."""
    rng = np.random.default_rng(2)
    model = mixing.Mixer(
        rng.integers(-127, 128, (mixing.KINDS, mixing.SLOTS)).astype(np.int8), rng.integers(0, mixing.SURE, (mixing.KINDS, mixing.SLOTS)).astype(np.uint8)
    )
    rows, data, _ = next(mixing.pair_bytes(mixing.pairs_of([b"ab", "é\0".encode(), b"b" * 30])))
    for half, halves in enumerate((data >> 4, data & 15)):
        x, gates = model.inputs(rows, data, half)
        x, gates = x.reshape(-1, 4, mixing.WIDTH), gates.reshape(-1, 4)
        for i, byte in enumerate(halves.tolist()):
            firsts = [int(at[i]) - byte for at in mixing.leaves_of(rows, data, half)]
            assert all(first % mixing.ROW == 0 for first in firsts)
            for place in range(4):
                node = 1 << place | byte >> (4 - place)
                assert x[i, place, : mixing.KINDS].tolist() == [model.stretched[k, first + node] for k, first in enumerate(firsts)]
                word, before = (int(model.sure[k, firsts[k] + node]) for k in (-2, -1))
                assert gates[i, place] == (place * mixing.SURE + word) * mixing.SURE + before
