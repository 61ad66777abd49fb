"""Similarity join of word-shingle sets: subsets for small sets, inverted lists for large ones.

Two sets link when their Jaccard similarity is at least ``percent`` / 100. The join is
size-aware. A set of at most ``boundary`` shingles is *light*: for every size that a partner may have it gives
its subsets of the size that the overlap must reach, and partners meet in an equal subset. A
larger set is *heavy*: its shingles are ordered from rare to frequent, and it enters the inverted
lists of so many rare ones that partners have at least ``common(n)`` of them in common. Light sets
that may have heavy partners enter lists, too. Subsets of a set grow fast with its size and list entries slowly; the
boundary is the size where giving subsets stops being cheaper than scanning lists of the mean
length in this table.

Scanning the lists counts the shared entries of each set, and sets with too few have no partner.
Of the others the *private* shingles are counted, which no other such set has. They are in no
overlap, so two sets of n and m shingles, p and q of them private, have an overlap of at most
min(n - p, m - q), and a pair whose similarity this keeps too low needs no comparison.

The lists are scanned for components, not for all pairs. Every member is compared with two pivots
of its list: the one whose own lists are longest together, which among edited copies is their
original or stands nearest to it, and one by hash. Links found join most members, and only members of one list that are
still in different components have to meet. Pairs of one component need no comparison, so a group of copies costs a few
comparisons for each member; no pair that could join two components is left out.

Long lists that are still open are dealt anew, ``ROUNDS`` times, by how their members differ from a centre x. If c and d
lack m and k of the N shingles of x, their overlap is N - m - k plus what their differences from x have in common. Two
that are not both linked with x can therefore only link if their differences share at least one shingle, mostly many, and each enters the lists of
so many of the rarest shingles of its difference that they meet in one; the others, and those that no other difference from x has, are never made rows. Members of the new lists are compared with
a centre there, and so on. Where the new lists of a centre have more than half of the pairs of its old ones, as among texts that share many passages and no original,
the old lists stay instead, so that dealing never multiplies what is open. Lists of at most ``PAIRED`` members are paired, as is, after a bound on each pair, what stays and what the last round leaves.

Equal sets are one class from the start. Shingles and classes are known by 64-bit hashes; set
overlaps are counted on 48 bits of them. Orders are by estimated frequency (a fixed table of
counts by hash): the estimate steers the work and has no part in which sets link.

Defined cases: null and empty texts and texts without words have no shingles, link with nothing, and are
their own component; a text with fewer than five words is one shingle; repeated rows are one
class; rows with a null key join components, whose id is the smallest key that is not null (null
if there is none).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.bloom import CHUNK, CHUNKS, Filter, OnceTwice, bits_for, merge_once_twice, parts_of
from tallyfield.llm.components import components
from tallyfield.llm.matching import only_matching
from tallyfield.llm.text import fields_and, map_pieces, mixed, pieces, texts, with_columns, word_hashes
from tallyfield.session import written

WORDS = 5
PERCENT = 80
CELLS = 1 << 22
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
LARGEST_LIGHT = 24
CLASSES_KEPT = 100_000
#: Members of a list that are paired as they are.
PAIRED = 16
#: How often open lists are dealt anew before all pairs of what is left are judged.
ROUNDS = 2
#: Parts that the members of one centre are spread over.
PARTS = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int, percent: int) -> int:
    """The overlap that a set of ``n`` needs with any partner at least."""
    return -(-n * percent // 100)


def common(n: int) -> int:
    """How many list entries a set of ``n`` has in common with a partner that is no smaller."""
    return 1 + n // 16


def largest_partner(n: int, percent: int) -> int:
    return n * 100 // percent


def shingle_sets(given: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.encode().lower().split() for t in given]
    lengths = [len(w) for w in split]
    flat = word_hashes([w for ws in split for w in ws])
    joined = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        joined = joined * _STEP + flat[k : len(flat) - words + 1 + k] if len(joined) else joined
    joined = mixed(joined + np.uint64(words))
    out, start = [], 0
    for n in lengths:
        if n >= words:
            ordered = np.sort(joined[start : start + n - words + 1])
            new = np.ones(len(ordered), bool)
            np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
            out.append(ordered[new])
        elif n:
            short = np.zeros(1, np.uint64)
            for h in flat[start : start + n]:
                short = short * _STEP + h
            out.append(mixed(short + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += n
    return out


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit id for a set; equal sets have equal ids."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def cell_counts(given: DataFrame, hashes_of, cells: int, purpose: str) -> DataFrame:
    """(chunk, n, squares, counts): how many of the hashes fall into each cell, by as many tasks as run at once.

    ``hashes_of`` gives the hashes of each piece of a batch of ``given``; their lowest bits name the cell.
    """
    tasks = 2 * given.sparkSession.sparkContext.defaultParallelism
    width = CHUNK // 4

    def build(batches):
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for hashes in hashes_of(batch):
                places = hashes & np.uint64(cells - 1)
                np.add.at(counts, places.astype(np.int64), 1)
        rows = counts.reshape(-1, width)
        used = np.flatnonzero(rows.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 256)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([rows[i].tobytes() for i in part], pa.binary())],
                names=["chunk", "counts"],
            )

    def merge(key, rows):
        total = np.zeros(width, np.int64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts.as_py(), np.uint32)
        return pa.table({
            "chunk": pa.array([key[0].as_py()], pa.int32()), "n": [int(total.sum())], "squares": [float((total.astype(float) ** 2).sum())],
            "counts": [total.tobytes()],
        })

    return written(
        given.coalesce(tasks).mapInArrow(build, "chunk int, counts binary")
        .groupBy("chunk").applyInArrow(merge, "chunk int, n long, squares double, counts binary"),
        purpose,
    )


def cell_levels(merged: DataFrame, cells: int, level_of) -> np.ndarray:
    """For each cell the level that ``level_of`` gives to its count, one byte each."""
    width = CHUNK // 4
    levels = np.zeros(cells, np.uint8)

    def level(batches):
        for batch in batches:
            found = [level_of(np.frombuffer(c, np.int64)).astype(np.uint8).tobytes() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["chunk", "levels"])

    for row in merged.select("chunk", "counts").mapInArrow(level, "chunk int, levels binary").collect():
        levels[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.levels, np.uint8)
    return levels


def frequency_levels(docs: DataFrame, text: str, cells: int = CELLS) -> tuple[np.ndarray, float]:
    """For each cell of shingle hashes the level of its count, and the mean length of a list.

    Counts of documents by hash cell, summed over all rows. Levels are half powers of two over the mean count.
    """

    def hashes_of(batch):
        for piece in pieces(batch, text):
            yield np.concatenate(shingle_sets(texts(piece, text)))

    merged = cell_counts(docs.select(text), hashes_of, cells, "shingle-counts")
    n, squares = merged.agg(F.sum("n"), F.sum("squares")).first()
    if not n:
        return np.zeros(cells, np.uint8), 1.0
    mean = n / cells
    levels = cell_levels(merged, cells, lambda counts: np.floor(2 * np.log2(np.maximum(counts / (mean + 1), 1))))
    return levels, max(1.0, squares / n - mean)


def light_boundary(percent: int, mean_list: float) -> int:
    """The largest size for which giving subsets costs no more than scanning inverted lists."""
    n = 1
    while n < LARGEST_LIGHT:
        partners = range(n + 1, largest_partner(n + 1, percent) + 1)
        subsets = sum(comb(n + 1, needed(m, percent)) for m in partners)
        if subsets > (n + 2 - needed(n + 1, percent)) * (1 + mean_list):
            break
        n += 1
    return n


def join_keys(shingles: np.ndarray, levels: np.ndarray, percent: int, boundary: int) -> np.ndarray:
    """The keys in which a set meets its partners: subsets if it is light, rare shingles if it has heavy partners."""
    n = len(shingles)
    if n == 0:
        return np.zeros(0, np.int64)
    most = largest_partner(n, percent)
    keys = []
    if n <= boundary:
        for m in range(n, min(boundary, most) + 1):
            size = needed(m, percent)
            if size <= n and not (m == n == size):  # equal sets are one class already
                seed = mixed(np.array([m], np.uint64) * _STEP)
                for chosen in combinations(shingles.tolist(), size):
                    keys.append(mixed(seed + np.bitwise_xor.reduce(mixed(np.array(chosen, np.uint64))))[0])
    if most > boundary:
        cells = (shingles & np.uint64(len(levels) - 1)).astype(np.int64)
        order = (levels[cells].astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
        rare = min(n, n - needed(n, percent) + common(n))
        chosen = np.argpartition(order, rare - 1)[:rare] if rare < n else np.arange(n)
        keys.extend(shingles[chosen])
    return np.array(keys, np.uint64).view(np.int64)


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


class _Seen:
    """Class ids met before in a task, up to a bounded number."""

    def __init__(self):
        self.ids: set[int] = set()

    def new(self, cls: int) -> bool:
        if cls in self.ids:
            return False
        if len(self.ids) > CLASSES_KEPT:
            self.ids.clear()
        self.ids.add(cls)
        return True


def _released(work):
    """The work on pieces of text, after each of which memory that Arrow holds unused goes back."""

    def run(piece):
        done = work(piece)
        pa.default_memory_pool().release_unused()
        return done

    return run


def keyed_sets(docs: DataFrame, text: str, levels: np.ndarray, percent: int, boundary: int) -> DataFrame:
    """``docs`` without text, with ``_class``, ``n_shingles`` and ``_keys``.

    A task gives the keys of a class once; the other rows of the class have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes

    def make():
        seen = _Seen()

        def work(piece):
            sets = shingle_sets(texts(piece, text))
            ids = [class_of(s) for s in sets]
            keys = [
                join_keys(s, shared.value, percent, boundary) if seen.new(c) else np.zeros(0, np.int64)
                for c, s in zip(ids, sets, strict=True)
            ]
            return with_columns(
                piece.drop_columns([text]),
                _class=pa.array(ids, pa.int64()),
                n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                _keys=pa.array(keys, pa.list_(pa.int64())),
            )

        return _released(work)

    added = {"_class": T.LongType(), "n_shingles": T.LongType(), "_keys": T.ArrayType(T.LongType())}
    kept = T.StructType([f for f in docs.schema.fields if f.name != text])
    return map_pieces(docs, text, fields_and(kept, **added), make)


def sets_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(_class, _set) of the classes in ``wanted``, once each.

    A Bloom filter of the wanted classes, of bounded size, spares most other texts the trip.
    """
    count = wanted.count()
    bits = bits_for(count)

    def build(batches):
        mine = Filter(bits)
        for batch in batches:
            mine.add(batch.column(0).to_numpy().view(np.uint64))
        rows = mine.data.reshape(-1, CHUNK)
        for part in parts_of(np.flatnonzero(rows.any(axis=1))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([rows[i].tobytes() for i in part], pa.binary())],
                names=["chunk", "bits"],
            )

    def merge(key, rows):
        total = np.zeros(CHUNK, np.uint8)
        for part in rows["bits"]:
            total |= np.frombuffer(part.as_py(), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": [total.tobytes()]})

    data = np.zeros(bits // 8, np.uint8)
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    parts = wanted.select("_class").coalesce(tasks).mapInArrow(build, "chunk int, bits binary")
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").collect():
        data[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(data)  # at most MOST_BITS bits

    def make():
        filter_, seen = Filter(bits, shared.value), _Seen()

        def work(piece):
            sets = shingle_sets(texts(piece, text))
            ids = np.array([class_of(s) for s in sets], np.int64)
            hit = [
                i for i in np.flatnonzero(filter_.has(ids.view(np.uint64))).tolist()
                if len(sets[i]) and seen.new(int(ids[i]))
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[hit], pa.int64()), pa.array([packed(sets[i]) for i in hit], pa.binary())],
                names=["_class", "_set"],
            )

        return _released(work)

    schema = T.StructType([T.StructField("_class", T.LongType()), T.StructField("_set", T.BinaryType())])
    found = map_pieces(docs.select(text), text, schema, make)
    return found.join(wanted.select("_class"), "_class", "left_semi").dropDuplicates(["_class"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    left = only_matching(sets.select(F.col("_class").alias("a"), F.col("_set").alias("_a")), "a", pairs, "a")
    right = only_matching(sets.select(F.col("_class").alias("b"), F.col("_set").alias("_b")), "b", pairs, "b")

    def check(batches):
        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True)):
                both = overlap(unpacked(x), unpacked(y))
                if 100 * both >= percent * ((len(x) + len(y)) // 6 - both):
                    hit.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b").mapInArrow(check, "a long, b long")


def private_counts(sets: DataFrame) -> DataFrame:
    """(c, private): how many shingles of each class no other class in ``sets`` has, at least.

    A filter of the shingles seen twice knows every shared one; a private one that it takes for
    shared makes the count smaller and later bounds weaker, and loses no pair.
    """
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.octet_length("_set"))).first()[0] or 0
    bits = bits_for(total // 6)

    def build(batches):
        seen = OnceTwice(bits)
        for batch in batches:
            for piece in pieces(batch, "_set"):
                seen.add(np.concatenate([mixed(unpacked(x)) for x in piece.column("_set").to_pylist()]))
        yield from seen.chunks()

    tasks = 2 * spark.sparkContext.defaultParallelism
    data = merge_once_twice(sets.select("_set").coalesce(tasks).mapInArrow(build, CHUNKS), bits)
    shared = spark.sparkContext.broadcast(data)  # at most MOST_BITS bits

    def make():
        twice = Filter(bits, shared.value)

        def work(piece):
            counts = [int((~twice.has(mixed(unpacked(x)))).sum()) for x in piece.column("_set").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [piece.column("_class"), pa.array(counts, pa.int64())], names=["c", "private"]
            )

        return _released(work)

    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("private", T.LongType())])
    return map_pieces(sets, "_set", schema, make)


def may_link(n, p, m, q, percent: int):
    """Whether sets of n and m shingles, p and q of them private, can be similar enough."""
    most = F.least(n - p, m - q)
    return 100 * most >= percent * (n + m - most)


def views(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, x, nx, missing, extra): for pairs of classes what the set of c lacks of that of x, and has beyond it.

    ``missing`` has a bit for each shingle of x, in its order.
    """
    left = only_matching(sets.select(F.col("_class").alias("c"), F.col("_set").alias("_c")), "c", pairs, "c")
    right = only_matching(sets.select(F.col("_class").alias("x"), F.col("_set").alias("_x")), "x", pairs, "x")

    def look(batches):
        for batch in batches:
            sizes, missing, extra = [], [], []
            for c, x in zip(batch.column("_c").to_pylist(), batch.column("_x").to_pylist(), strict=True):
                mine, other = unpacked(c), unpacked(x)
                lacks = ~np.isin(other, mine, assume_unique=True)
                bits = np.packbits(lacks)
                missing.append(np.pad(bits, (0, -len(bits) % 8)).view(np.int64))
                sizes.append(len(other))
                extra.append(len(mine) - len(other) + int(lacks.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("x"), pa.array(sizes, pa.int64()), pa.array(missing, pa.list_(pa.int64())), pa.array(extra, pa.int64())],
                names=["c", "x", "nx", "missing", "extra"],
            )

    both = pairs.join(left, "c").join(right, "x").select("c", "x", "_c", "_x")
    return both.mapInArrow(look, "c long, x long, nx long, missing array<long>, extra long")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, x, n, nx, m, near, differ): for pairs of classes their sizes, how many of the shingles of x the set of c
    lacks, whether the two link, and the shingles that one of them has alone.
    """
    left = only_matching(sets.select(F.col("_class").alias("c"), F.col("_set").alias("_c")), "c", pairs, "c")
    right = only_matching(sets.select(F.col("_class").alias("x"), F.col("_set").alias("_x")), "x", pairs, "x")

    def look(batches):
        for batch in batches:
            sizes, others, lacks, near, differ = [], [], [], [], []
            for c, x in zip(batch.column("_c").to_pylist(), batch.column("_x").to_pylist(), strict=True):
                mine, other = unpacked(c), unpacked(x)
                apart = np.setxor1d(mine, other, assume_unique=True)
                both = (len(mine) + len(other) - len(apart)) // 2
                sizes.append(len(mine))
                others.append(len(other))
                lacks.append(len(other) - both)
                near.append(100 * both >= percent * (len(mine) + len(other) - both))
                differ.append(apart.view(np.int64))
            columns = [pa.array(v, pa.int64()) for v in (sizes, others, lacks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("c"), batch.column("x"), *columns, pa.array(near, pa.bool_()), pa.array(differ, pa.list_(pa.int64()))],
                names=["c", "x", "n", "nx", "m", "near", "differ"],
            )

    both = pairs.join(left, "c").join(right, "x").select("c", "x", "_c", "_x")
    return both.mapInArrow(look, "c long, x long, n long, nx long, m long, near boolean, differ array<long>")


def difference_keys(x: int, differ: np.ndarray) -> np.ndarray:
    """The keys of the lists of centre ``x`` that the shingles of a difference from it have."""
    return mixed(mixed(np.array([x], np.int64).view(np.uint64)) + differ.view(np.uint64))


def held_levels(seen: DataFrame) -> np.ndarray:
    """For each cell of the keys of differences 0 if one difference at most has such a key, else a level that grows with their number.

    There are about twice as many cells as keys, ``MOST_CELLS`` at most; with more keys than that more of them look shared.
    """
    total = seen.agg(F.sum(F.size("differ"))).first()[0] or 0
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * total).bit_length()))

    def hashes_of(batch):
        for x, differ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield difference_keys(x, differ.values.to_numpy())

    def level(counts):
        return np.where(counts > 1, np.floor(2 * np.log2(np.maximum(counts, 1))), 0)

    return cell_levels(cell_counts(seen.select("x", "differ"), hashes_of, cells, "difference-counts"), cells, level)


def lists_by_difference(seen: DataFrame, percent: int) -> DataFrame:
    """(key, c, x): lists in which all members of a centre meet that may link and are not both linked with it.

    c and d link if their differences share t = (w(c) + w(d)) / (100 + percent) - nx shingles, where w is
    percent * n + (100 + percent) * m; with the least w of possible partners this bounds t for c alone. t is over 0, since
    w is at least percent * nx for all, and over 100 * nx for those not linked with the centre. What c has of x is, but for the shingles that
    c has beyond d, in d too, so w(d) is at least w(c) - (100 - percent) * n(d), and n(d) at most 100 * n / percent. Of the d
    shingles of a difference that others may have, too, the rarest d - t + 1 are entered, and only these become rows; which
    others may have and which are rare is told by counts by hash cell, of fixed size, that take none for private that another has.
    """
    whole = 100 + percent
    seen = seen.withColumn("w", percent * F.col("n") + whole * F.col("m"))
    least = seen.groupBy("x").agg(F.min("w").alias("any"), F.min(F.when(~F.col("near"), F.col("w"))).alias("far"))
    least = least.where("far is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = seen.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(PARTS)).cast("int")).join(least, ["x", "part"])
    partner = F.greatest(
        F.when(F.col("near"), F.col("far")).otherwise(F.col("any")),
        F.col("w") - F.ceil((100 - percent) * 100 * F.col("n") / percent),
    )
    share = F.greatest(F.lit(1), F.ceil((F.col("w") + partner - whole * F.col("nx")) / whole)).cast("long")
    shared = seen.sparkSession.sparkContext.broadcast(held_levels(seen))  # at most MOST_CELLS bytes

    def enter(batches):
        levels = shared.value
        for batch in batches:
            keys, members, centres = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            columns = (batch.column(k).to_pylist() for k in ("x", "c", "t"))
            for x, c, t, differ in zip(*columns, batch.column("differ"), strict=True):
                own = difference_keys(x, differ.values.to_numpy())
                level = levels[(own & np.uint64(len(levels) - 1)).astype(np.int64)]
                own, level = own[level > 0], level[level > 0]
                if len(own) >= t:
                    keys.append(own[np.lexsort((own, level))[: len(own) - t + 1]])
                    members.append(np.full(len(keys[-1]), c))
                    centres.append(np.full(len(keys[-1]), x))
            columns = np.concatenate(keys).view(np.int64), np.concatenate(members), np.concatenate(centres)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["key", "c", "x"])

    return dealt.select("x", "c", share.alias("t"), "differ").mapInArrow(enter, "key long, c long, x long")


def still_open(members: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``members`` with the component ``g``, of lists that have several."""
    known = members.join(placed, F.col("c") == F.col("node"), "left").withColumn("g", F.coalesce("component", "c"))
    known = written(known.drop("node", "component"), "placed-members")
    several = known.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 != g1").select("key")
    return written(known.join(several, "key", "left_semi"), "open-members")


def list_pairs(lists: DataFrame, name: str) -> DataFrame:
    """(x, name): the squares of the lengths of each centre's lists, summed."""
    n = F.count(F.lit(1)).cast("double")
    return lists.groupBy("key", "x").agg((n * n).alias("n")).groupBy("x").agg(F.sum("n").alias(name))


def met(rows: DataFrame, percent: int, condition=None) -> DataFrame:
    """(a, b): the members of one list in different components that may link by their private shingles."""
    mine, other = rows.alias("l"), rows.alias("r")
    col = lambda side, name: F.col(f"{side}.{name}")
    bound = may_link(*(col(s, f) for s in "lr" for f in ("n", "private")), percent)
    on = (col("l", "key") == col("r", "key")) & (col("l", "g") < col("r", "g")) & bound
    found = mine.join(other, on & condition(col) if condition else on)
    return found.select(F.greatest(col("l", "c"), col("r", "c")).alias("a"), F.least(col("l", "c"), col("r", "c")).alias("b"))


def close_pairs(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of members of one list, in different components, that may be similar enough.

    Each is seen from the list's centre x. Of the shingles of x a pair has in common at most those that neither lacks,
    and of the others at most what either has beyond x and its private ones. The bound is a condition of
    the join, and pairs that it rules out are no rows.
    """
    seen = written(views(written(many.select("c", "x").distinct(), "view-pairs"), sets), "open-views")
    many = many.join(seen, ["c", "x"]).withColumn("extra", F.col("extra") - F.col("private"))

    def close(col) -> Column:
        lacked = F.aggregate(
            F.zip_with(col("l", "missing"), col("r", "missing"), lambda x, y: F.bit_count(x.bitwiseOR(y))),
            F.lit(0), lambda total, n: total + n,
        )
        most = col("l", "nx") - lacked + F.least(col("l", "extra"), col("r", "extra"))
        return (col("l", "x") == col("r", "x")) & (100 * most >= percent * (col("l", "n") + col("r", "n") - most))

    return met(many, percent, close)


def remaining_links(
    open_: DataFrame, links: DataFrame, placed: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS
) -> DataFrame:
    """``links`` and so many more that all members of the lists ``open_`` that link are in one component.

    ``placed`` has the components of ``links``.
    """
    of_class = open_.select("c", "n", "private").distinct()
    pairs, stay, known_links = [], [], links.count()
    for left in range(rounds, -1, -1):
        centre = F.min(F.struct("private", F.xxhash64("c").alias("h"), "c"))["c"].alias("x")
        sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), centre)
        known = open_.join(sizes, "key")
        pairs.append(met(known.where(F.col("_size") <= PAIRED), percent))
        many = written(known.where(F.col("_size") > PAIRED).drop("_size"), "open-lists")
        if many.isEmpty():
            break
        if not left:
            stay.append(many)
            break
        centred = written(many.where("c != x").select("c", "x").distinct(), "centred-pairs")
        seen = written(differences(centred, sets, percent), "differences")
        near = seen.where("near").select(F.greatest("c", "x").alias("a"), F.least("c", "x").alias("b"))
        links = written(links.union(near).distinct(), "round-links")
        if (count := links.count()) > known_links:
            placed, known_links = written(components(links), "round-components"), count
        dealt = still_open(lists_by_difference(seen, percent).join(of_class, "c"), placed)
        worse = list_pairs(many, "before").join(list_pairs(dealt, "after"), "x").where("2 * after > before").select("x")
        worse = written(worse, "undealt-centres")
        stay.append(many.join(worse, "x", "left_semi"))
        open_ = dealt.join(worse, "x", "left_anti").drop("x")
    if stay:  # a key may name lists of two rounds, with a centre each
        left_over = reduce(DataFrame.unionByName, stay).drop("g").distinct()
        pairs.append(close_pairs(still_open(left_over, placed), sets, percent))
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    rest = written(found.distinct().join(links, ["a", "b"], "left_anti"), "open-pairs")
    return links.union(written(linked(rest, sets, percent), "open-links"))


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, boundary: int | None = None
) -> DataFrame:
    """``docs`` without its text, with ``n_shingles`` and ``component_id``.

    ``boundary`` is the largest light set, by cost if it is not given.
    """
    levels, mean_list = frequency_levels(docs, text)
    if boundary is None:
        boundary = light_boundary(percent, mean_list)
    rows = written(keyed_sets(docs, text, levels, percent, boundary), "shingle-keys")

    # A class comes from each task that met it. Lists of one class are dropped before anything else is done with them.
    entries = rows.select(F.explode("_keys").alias("key"), F.col("_class").alias("c"), F.col("n_shingles").alias("n"))
    several = entries.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("key")
    members = written(entries.join(several, "key", "left_semi").distinct(), "list-members")
    # a partner may be as small as the overlap that this set needs
    least = F.floor((F.col("n") * percent + 99) / 100).cast("long")
    wanted = written(
        members.groupBy("c", "n").agg(F.count(F.lit(1)).alias("entries"))
        .where((F.col("entries") >= 1 + F.floor(least / 16)) | (F.col("n") <= boundary))
        .select(F.col("c").alias("_class")),
        "wanted-sets",
    )
    sets = written(sets_of(docs, text, wanted), "sets")
    private = written(private_counts(sets), "private-shingles")
    members = members.join(private, "c").where(100 * (F.col("n") - F.col("private")) >= percent * F.col("n"))
    members = written(members, "possible-members")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = members.join(sizes, "key").groupBy("c").agg(F.sum("size").alias("weight"))
    member = F.struct("c", "n", "private")
    pivots = (
        members.join(weights, "c")
        .groupBy("key")
        .agg(
            F.max(F.struct(F.col("weight"), F.xxhash64("c").alias("h"), member.alias("p"))).alias("x"),
            F.min(F.struct(F.xxhash64("c").alias("h"), member.alias("p"))).alias("y"),
        )
        .select("key", F.explode(F.array_distinct(F.array("x.p", "y.p"))).alias("y"))
    )
    pairs = members.join(pivots, "key").select(member.alias("x"), "y").where(F.col("x.c") != F.col("y.c"))
    stars = written(
        pairs.where(may_link(*(F.col(f"{s}.{f}") for s in "xy" for f in ("n", "private")), percent))
        .select(F.greatest("x.c", "y.c").alias("a"), F.least("x.c", "y.c").alias("b"))
        .distinct(),
        "stars",
    )
    links = written(linked(stars, sets, percent), "star-links")
    joined = written(components(links), "star-components")

    open_ = still_open(members, joined)
    final = written(components(remaining_links(open_, links, joined, sets, percent)), "components")

    class_key = rows.groupBy("_class").agg(F.min(key).alias("_least")).join(
        final.withColumnRenamed("node", "_class"), "_class", "left"
    ).withColumn("_group", F.coalesce("component", "_class"))
    group_key = class_key.groupBy("_group").agg(F.min("_least").alias("component_id"))
    of_class = written(
        class_key.join(group_key, "_group").select("_class", "component_id"), "class-components"
    )
    out = rows.drop("_keys", "component_id").join(of_class, "_class", "left")
    lone = F.col("n_shingles") == 0
    return out.withColumn("component_id", F.when(lone, F.col(key)).otherwise(F.col("component_id"))).drop("_class")
