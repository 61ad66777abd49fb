"""Quality rules: counts over whole texts, and gradient-boosted trees as flat node arrays.

The trees see statistics of a text and are fitted to labels with logistic loss. On chosen
features the score may only rise or only fall: a split that would break the order is refused, and
the halves below a split stay on their sides of the middle of its two values. A fitted forest is
five arrays, and scoring walks all rows of a batch through all trees level by level.

The forest is fitted on at most ``SAMPLE_ROWS`` labelled rows, the ones with the smallest hash of
their key; counts and scores cover every document.

Defined cases: a null text has no words, and fails; repeated rows are scored alike; null labels
are left out; without labelled rows the forest is empty and keeps what the base rules keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.kernel import matrix
from tallyfield.llm.stats import COUNTS, FEATURES, text_stats
from tallyfield.llm.text import fields_and, map_pieces, texts, with_columns
from tallyfield.session import written

SAMPLE_ROWS = 20_000
TREES = 60
DEPTH = 3
BINS = 48
RATE = 0.2
LEAF_WEIGHT = 2.0
#: +1: more of it never lowers the score; -1: more of it never raises it.
MONOTONE = {
    "symbol_share": -1,
    "bang_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 1,
}


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf is its own child. ``roots`` has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for each row."""
        total = np.full(len(features), self.base)
        rows = np.arange(len(features))
        for root in self.roots.tolist():
            node = np.full(len(features), root)
            for _ in range(DEPTH):
                low = features[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features), -50, 50)))


def fit_forest(features: np.ndarray, label: np.ndarray, monotone: dict[str, int] = MONOTONE) -> Forest:
    """Boost ``TREES`` trees of ``DEPTH`` levels over histograms of the features."""
    empty = np.zeros(0, np.int32)
    if not len(label):
        return Forest(empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0.0)
    signs = np.array([monotone.get(f, 0) for f in FEATURES])
    cuts = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in features.T]
    codes = np.stack([np.searchsorted(c, x, side="left") for c, x in zip(cuts, features.T, strict=True)], axis=1)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(label), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def value_of(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + LEAF_WEIGHT), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = gradient[rows], hessian[rows]
        here = value_of(g.sum(), h.sum(), low, high)
        best = None
        if depth < DEPTH:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                gs = np.cumsum(np.bincount(codes[rows, f], g, BINS))
                hs = np.cumsum(np.bincount(codes[rows, f], h, BINS))
                gl, hl = gs[: len(cut)], hs[: len(cut)]
                gr, hr = gs[-1] - gl, hs[-1] - hl
                vl = np.clip(-gl / (hl + LEAF_WEIGHT), low, high)
                vr = np.clip(-gr / (hr + LEAF_WEIGHT), low, high)
                gain = -(gl * vl + 0.5 * (hl + LEAF_WEIGHT) * vl**2 + gr * vr + 0.5 * (hr + LEAF_WEIGHT) * vr**2)
                gain += g.sum() * here + 0.5 * (h.sum() + LEAF_WEIGHT) * here**2
                fits = (hl > 1) & (hr > 1) & (signs[f] * (vr - vl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                    best = (gain[at], f, at, vl[at], vr[at])
        if best is None:
            return leaf(RATE * here)
        _, f, at, vl, vr = best
        middle = (vl + vr) / 2
        lows, highs = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle))
        if signs[f] == 0:
            lows = highs = (low, high)
        me = leaf(0.0)
        goes_low = codes[rows, f] <= at
        a = grow(rows[goes_low], depth + 1, *lows)
        b = grow(rows[~goes_low], depth + 1, *highs)
        nodes[me] = [f, cuts[f][at], a, b, 0.0]
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - label, p * (1 - p)
        first = len(nodes)
        roots.append(grow(np.arange(len(label)), 0, -np.inf, np.inf))
        tree = _flat(nodes[first:], first, [0], 0.0)
        margin += tree.margin(features)
    return _flat(nodes, 0, roots, base)


def _flat(nodes: list[list], shift: int, roots: list[int], base: float) -> Forest:
    f, t, a, b, v = zip(*nodes, strict=True)
    return Forest(
        np.array(f, np.int32), np.array(t, float), np.array(a, np.int32) - shift,
        np.array(b, np.int32) - shift, np.array(v, float), np.array(roots, np.int32), base,
    )


def add_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``COUNTS`` and the array ``features`` of each whole text."""

    def make():
        def work(piece):
            found = [text_stats(t) for t in texts(piece, text)]
            counts = {
                name: pa.array([c[i] for c, _ in found], pa.int64()) for i, name in enumerate(COUNTS)
            }
            return with_columns(
                piece, **counts, features=pa.array([f for _, f in found], pa.list_(pa.float64()))
            )

        return work

    added = {name: T.LongType() for name in COUNTS} | {"features": T.ArrayType(T.DoubleType())}
    return map_pieces(df, text, fields_and(df.schema, **added), make)


def score_forest(df: DataFrame, forest: Forest, features: str = "features") -> DataFrame:
    """Add ``model_score``, the forest's probability of label 1."""

    def run(batches):
        for batch in batches:
            p = forest.probability(matrix(batch.column(features), len(FEATURES)))
            yield with_columns(batch, model_score=pa.array(p, pa.float64()))

    return df.mapInArrow(run, fields_and(df.schema, model_score=T.DoubleType()))


def ordered_sample(rows: DataFrame, size: int) -> list:
    """The first ``size`` rows by ``_order`` (a 64-bit hash), label and features.

    Rows are cut by hash to some more than ``size`` before they are put in order, so that neither the tasks nor
    the driver get rows by the number of tasks; the order is settled on executors, and the driver reads ``size`` rows.
    """
    rows = written(rows, "labelled")
    n = rows.count()
    share = 1.25 * size / max(n, 1)
    cut = rows
    while share < 1:
        cut = rows.where(F.col("_order") < int((share - 0.5) * 2.0**64))
        if cut.count() >= size:
            break
        share, cut = 2 * share, rows
    return written(cut.orderBy("_order", "_label", "features").limit(size), "sample").collect()


def quality_rules(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Judge every document; gives ``docs`` without its text, with the counts, ``model_score``,
    ``base_failed`` and ``kept``.

    The base rules fail fewer than 50 words, and repeated windows over more than half the words.
    """
    stats = written(add_counts(docs, text).drop(text), "text-counts")
    known = labels.where(F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")
    )
    sample = ordered_sample(stats.join(known, F.col(key) == F.col("_key")).select(
        "features", "_label", F.xxhash64("_key").alias("_order")
    ), sample_rows)
    forest = fit_forest(
        np.array([r.features for r in sample]).reshape(-1, len(FEATURES)), np.array([r._label for r in sample])
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        score_forest(stats, forest)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("model_score") >= 0.5))
    )
