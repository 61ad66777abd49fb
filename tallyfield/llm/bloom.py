"""Bloom filters as byte arrays that tasks build and Spark merges piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfield.llm.text import mixed

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BITS_FOR_EACH = 16
CHUNK = 8192
#: Chunks that a task gives at once, so that a filter is never copied whole.
CHUNKS_AT_ONCE = 256


def bits_for(count: int, most: int = MOST_BITS) -> int:
    """A power of two of about ``BITS_FOR_EACH`` bits for each item, at most ``most``.

    Beyond that number of items more of them test positive by chance, and none is missed.
    """
    return int(min(most, max(LEAST_BITS, 1 << (BITS_FOR_EACH * max(count, 1) - 1).bit_length())))


class Filter:
    """A Bloom filter with two places for each 64-bit hash."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    def _places(self, hashes: np.ndarray):
        return hashes & self.mask, mixed(hashes) & self.mask

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for p in self._places(hashes):
            found &= (self.data[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def add(self, hashes: np.ndarray) -> None:
        for p in self._places(hashes):
            bit = np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8))
            np.bitwise_or.at(self.data, (p >> np.uint64(3)).astype(np.int64), bit)


def parts_of(used: np.ndarray) -> list[np.ndarray]:
    """Runs of at most ``CHUNKS_AT_ONCE`` chunk numbers, one at least."""
    return np.array_split(used, max(1, -(-len(used) // CHUNKS_AT_ONCE)))


class OnceTwice:
    """Filters of the hashes seen in at least one document and of those seen in at least two."""

    def __init__(self, bits: int):
        self.once, self.twice = Filter(bits), Filter(bits)

    def add(self, hashes: np.ndarray) -> None:
        """Add hashes; each document gives a hash once at most."""
        new, counts = np.unique(hashes, return_counts=True)
        self.twice.add(new[(counts > 1) | self.once.has(new)])
        self.once.add(new)

    def chunks(self) -> Iterator[pa.RecordBatch]:
        """The chunks that hold a bit."""
        once, twice = self.once.data.reshape(-1, CHUNK), self.twice.data.reshape(-1, CHUNK)
        for part in parts_of(np.flatnonzero(once.any(axis=1))):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part.astype(np.int32)),
                    pa.array([once[i].tobytes() for i in part], pa.binary()),
                    pa.array([twice[i].tobytes() for i in part], pa.binary()),
                ],
                names=["chunk", "once", "twice"],
            )


CHUNKS = "chunk int, once binary, twice binary"


def merge_once_twice(parts: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter of all parts. A hash is seen twice, too, if two parts saw it once.

    A group has one row for each task that built filters, each of ``CHUNK`` bytes twice; the
    result has ``bits`` bits.
    """

    def merge(key, rows):
        once, twice = np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)
        for a, b in zip(rows["once"], rows["twice"], strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            twice |= b | (once & a)
            once |= a
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "twice": [twice.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk int, twice binary").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.twice, np.uint8)
    return out
