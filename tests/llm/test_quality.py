import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyfield.llm import plans
from tallyfield.llm.kernel import isotonic, quality_scores
from tallyfield.llm.stats import FEATURES, text_stats
from tallyfield.llm.trees import MONOTONE, fit_forest, ordered_sample, quality_rules
from tests.llm.cases import SF_DIR, documents, real_documents, with_clashes, words

BLANK = " \t\n\x0b\x0c\r"


def counts(text):
    text = text or ""
    ws = words(text)
    windows = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dups += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


ODD = [
    "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y\nx y\n\n\nx y ", "é ü ü # * <>", "one\r\none\r\n",
    "a b c d a b c e a b", "word " * 200, "Ab cd. " * 3 + "\n" + "w" * 40_000,
]


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert text_stats(text)[0] == counts(text)


def test_op4_query(spark):
    got = {r.doc_id: r for r in plans.op4_quality_rules(spark, SF_DIR).collect()}
    docs = real_documents()
    assert len(got) == len(docs)
    for doc_id, text, *_ in docs:
        row = got[doc_id]
        n, chars, symbols, dups, repeats = counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            n, chars, symbols, dups, repeats,
        )
        assert row.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert row.kept == (not row.base_failed and row.model_score >= 0.5)


def test_op4_agrees_with_labels(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall())
    rows = [r for r in plans.op4_quality_rules(spark, SF_DIR).collect() if r.doc_id in labels and not r.base_failed]
    right = sum(r.kept == bool(labels[r.doc_id]) for r in rows)
    assert right / len(rows) > 0.95


def auc(scores, labels):
    pairs = [(a, b) for a, y in zip(scores, labels, strict=True) if y for b, z in zip(scores, labels, strict=True) if not z]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)


def test_op6_held_out(spark):
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = plans.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.9
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.9


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 9, 12).astype(float)
        y = np.array([rng.integers(0, k + 1) for k in n.astype(int)], float)
        fit = isotonic(n, y)
        # the largest over starts of the smallest over ends of the mean between them
        want = [
            max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, 12)) for a in range(i + 1))
            for i in range(12)
        ]
        assert np.allclose(fit, want)


def test_forest_is_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(FEATURES)))
    name = "symbol_share"
    f = FEATURES.index(name)
    y = (np.sin(8 * x[:, f]) + x[:, 0] + 0.3 * rng.standard_normal(3000) > 0.5).astype(float)
    forest = fit_forest(x, y)
    grid = np.repeat(x[:50], 60, axis=0)
    grid[:, f] = np.tile(np.linspace(0, 1, 60), 50)
    steps = np.diff(forest.margin(grid).reshape(50, 60), axis=1)
    assert MONOTONE[name] == -1 and (steps <= 1e-12).all()
    free = FEATURES.index("mean_word")
    grid[:, free] = np.tile(np.linspace(0, 1, 60), 50)
    walked = [_walk(forest, row) for row in grid[:200]]
    assert np.allclose(forest.margin(grid[:200]), walked)


def _walk(forest, row):
    total = forest.base
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        total += forest.value[node]
    return total


@pytest.mark.parametrize("model", [quality_scores, quality_rules])
def test_odd_rows(spark, model):
    good, bad = "Some words of a plain text, all of them fine. " * 6, "!! ## " * 60
    rows = [(i, (good if i % 2 else bad) + str(i)) for i in range(60)]
    rows += [(100, None), (101, ""), (None, good), (7, rows[7][1]), (7, rows[7][1]), (102, "x" * 100_000)]
    labels = [(i, i % 2) for i in range(60)] + [(None, 1), (7, None), (7, 1), (7, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality long")
    docs = with_clashes(documents(spark, rows)).drop("held_out")
    got = model(docs.select("doc_id", "text", "owner"), known).collect()
    assert len(got) == len(rows)
    assert len(model(documents(spark, []), known).collect()) == 0
    alone = model(documents(spark, rows).select("doc_id", "text"), known.limit(0)).collect()
    assert len(alone) == len(rows)
    if model is quality_scores:
        assert {r.score for r in alone} == {0.5}
        assert all(r.score is not None for r in got)
        means = [np.mean([r.score for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == k]) for k in (0, 1)]
        assert means[0] < means[1]
    else:
        assert all(r.kept == (not r.base_failed) for r in alone)


@pytest.mark.parametrize("size", [1, 30, 999, 1000, 5000])
def test_sample_is_the_least_rows_by_hash(spark, size):
    """Also where a third of all rows share a key, so that a cut by hash is far off its share."""
    from pyspark.sql import functions as F

    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    rows = spark.range(1000).select(
        F.array((F.col("id") % 5).cast("double")).alias("features"), (F.col("id") % 2).cast("double").alias("_label"),
        F.xxhash64(key).alias("_order"),
    )
    got = ordered_sample(rows.repartition(5), size)
    want = rows.orderBy("_order", "_label", "features").limit(size).collect()
    assert sorted((r._order, r._label, r.features) for r in got) == sorted((r._order, r._label, r.features) for r in want)


def test_sample_of_no_rows(spark):
    assert ordered_sample(spark.createDataFrame([], "features array<double>, _label double, _order long"), 10) == []
