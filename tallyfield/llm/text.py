"""Texts and words of Arrow batches, for the operators that work in Python.

Words are the contracts' ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` cuts at exactly these six
bytes, none of which occurs inside a multi-byte character, and ``bytes.lower()`` lowers A-Z only.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

import tallyfield

BLANKS = " \t\n\x0b\x0c\r"
PIECE_BYTES = 1 << 20


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but stands at the same path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(tallyfield.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null becomes empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def map_pieces(df: DataFrame, column: str, schema: T.StructType, make: Callable[[], Callable]) -> DataFrame:
    """Run a function over pieces of each partition.

    ``make()`` is called once in each task and gives the function from a piece to an Arrow batch
    or table, so that a cache lives as long as the task.
    """

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch, column):
                out = work(piece)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with added columns, or replaced ones of the same name."""
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in names] + list(columns.values()), names=names + list(columns)
    )


def fields_and(schema: T.StructType, **added: T.DataType) -> T.StructType:
    """The schema that ``with_columns`` gives."""
    kept = [f for f in schema.fields if f.name not in added]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: the finishing steps of a well-known hash, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
