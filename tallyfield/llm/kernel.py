"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of each text are standardised and mapped to cosines of random directions, whose inner
products approximate a Gaussian kernel. Each partition of labelled rows adds up its part of the
normal equations; the sums, whose size is fixed by the number of features, give the ridge
weights. Ridge scores are counted in fixed bins with their labels, and pooling neighbours that
fall makes them a monotone probability. All labelled rows count; nothing is sampled.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any
other; a null label is left out; a document labelled more than once counts once for each label;
repeated documents each count; rows with a null key have no label. Without labelled rows every
score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.stats import FEATURES, text_stats
from tallyfield.llm.text import fields_and, map_pieces, texts, with_columns
from tallyfield.session import written

DIRECTIONS = 192
WIDTH = 4.0
RIDGE = 1.0
SCORE_BINS = 1000
SEED = 20240611


@dataclass
class KernelModel:
    """What scoring needs; the size depends on the parameters only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def fourier(self, features: np.ndarray) -> np.ndarray:
        """Cosines of the standardised features along the random directions, and a constant."""
        z = np.clip((features - self.mean) / self.scale, -8, 8) @ self.directions + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(z), 1))])

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.fourier(features) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), 0.5)
        return np.interp(self.raw(features), self.knots, self.levels)


def add_features(df: DataFrame, text: str = "text", features: str = "features") -> DataFrame:
    """Add the statistics of each whole text as an array."""

    def make():
        def work(piece):
            rows = [text_stats(t)[1] for t in texts(piece, text)]
            return with_columns(piece, **{features: pa.array(rows, pa.list_(pa.float64()))})

        return work

    return map_pieces(df, text, fields_and(df.schema, **{features: T.ArrayType(T.DoubleType())}), make)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def isotonic(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The non-decreasing share of ones nearest to the shares of consecutive bins (pooling neighbours)."""
    blocks: list[list[float]] = []
    for n, y in zip(total.tolist(), ones.tolist(), strict=True):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, y2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + y2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for n, y, k in blocks])


def fit_kernel(
    labelled: DataFrame, features: str = "features", label: str = "quality", width: float = WIDTH
) -> KernelModel:
    """Fit on all rows of ``labelled`` that have a label (0 or 1)."""
    rows = labelled.where(F.col(label).isNotNull()).select(features, F.col(label).cast("double").alias("y"))
    count = len(FEATURES)
    moments = (
        rows.select(F.posexplode(features).alias("at", "x"))
        .groupBy("at")
        .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
        .collect()
    )
    mean, scale = np.zeros(count), np.ones(count)
    for m in moments:
        mean[m.at], scale[m.at] = m.mean, m.sd or 1.0
    rng = np.random.default_rng(SEED)
    model = KernelModel(
        mean, scale,
        rng.standard_normal((count, DIRECTIONS)) / width,
        rng.uniform(0, 2 * np.pi, DIRECTIONS),
        None, np.array([0.0]), np.array([0.5]),
    )
    if not moments:
        return model
    size = DIRECTIONS + 1

    def sums(batches):
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.fourier(matrix(batch.column(0), count))
            left += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["left", "right"]
        )

    def added(batches):
        left, right = np.zeros(size * size), np.zeros(size)
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left += np.frombuffer(a)
                right += np.frombuffer(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["left", "right"]
        )

    parts = rows.mapInArrow(sums, "left binary, right binary")
    left, right = np.zeros(size * size), np.zeros(size)
    for part in parts.repartition(8).mapInArrow(added, "left binary, right binary").collect():
        left += np.frombuffer(part.left)
        right += np.frombuffer(part.right)
    model.weights = np.linalg.solve(left.reshape(size, size) + RIDGE * np.eye(size), right)

    def binned(batches):
        for batch in batches:
            raw = model.raw(matrix(batch.column(0), count))
            bins = np.floor((np.clip(raw, -0.5, 1.5) + 0.5) * SCORE_BINS / 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "y"])

    bins = (
        rows.mapInArrow(binned, "bin int, y double")
        .groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("ones"))
        .orderBy("bin").collect()
    )
    total, ones = np.array([b.n for b in bins], float), np.array([b.ones for b in bins])
    model.knots = (np.array([b.bin for b in bins]) + 0.5) * 2 / SCORE_BINS - 0.5
    model.levels = isotonic(total, ones)
    return model


def score_kernel(df: DataFrame, model: KernelModel, features: str = "features") -> DataFrame:
    """Add ``score``, the calibrated probability of label 1, from a column of statistics."""

    def run(batches):
        for batch in batches:
            scores = model.score(matrix(batch.column(features), len(FEATURES)))
            yield with_columns(batch, score=pa.array(scores, pa.float64()))

    return df.mapInArrow(run, fields_and(df.schema, score=T.DoubleType()))


def score_texts(df: DataFrame, model: KernelModel, text: str = "text") -> DataFrame:
    """Add ``score`` straight from the texts, without a column of statistics; texts go to Python once."""

    def make():
        def work(piece):
            features = np.array([text_stats(t)[1] for t in texts(piece, text)])
            return with_columns(piece, score=pa.array(model.score(features), pa.float64()))

        return work

    return map_pieces(df, text, fields_and(df.schema, score=T.DoubleType()), make)


def fold(key: str, count: int):
    """crc32 of a key as text, modulo ``count``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(count))


def fit_for_labels(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> tuple[KernelModel, DataFrame]:
    """A model of the labels outside the fold whose crc32 modulo 3 is 1, and the documents' statistics.

    The statistics, without texts, are written once; the model is fitted from them.
    """
    narrow = add_features(docs, text).drop(text)
    stats = written(narrow.withColumn("held_out", fold(key, 3) == 1), "text-stats")
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label"))
    labelled = stats.where(~F.col("held_out")).join(known, F.col(key) == F.col("_key"))
    return fit_kernel(labelled.select("features", "_label"), label="_label"), stats


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Score every document; labels of the held-out fold are never read.

    Gives ``docs`` without its text, with ``features``, ``held_out``, ``score`` and ``predicted``.
    """
    model, stats = fit_for_labels(docs, labels, key, text, label)
    return score_kernel(stats, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
