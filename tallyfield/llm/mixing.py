"""Language-model scores by logistic mixing of hashed-context bit predictors.

The words of a text, each with the blank after it, are coded bit by bit, one after the other. Six predictors look at the one,
two, four and six bytes before, over the end of the word before too, at the whole beginning of the word, and at that with the
word before (its last ``BEFORE`` bytes; no context reaches further back). Each has a table of ``SLOTS``
counts by the hash of its context and the bits of the byte so far. Their stretched probabilities are mixed
with weights that a gate selects: the bit's place and how sure two predictors are. The weights are learned
online, batch after batch within each partition, and averaged over partitions between rounds. An
adaptive map refines the mixed probability.

Over the words of a document the mixed bits are weighed with word tables by how well each has coded it so far, block
after block, and may take over from each other: a table of the frequent words, the same table for
each class of the training documents (such as their language; a document's own class is never
looked at), and one for texts of rare words. A word table gives words that it does not hold one share together, and
the mixed bits spell the word. The share is the one of the other words and of words found once, however many words there are.

Counts come from all bytes of the training documents; one fold of them (``TUNING``)
is left out of the bit tables, and the weights and the map are learned on it. What the bits of a word cost depends on
the word and the one before, so a task counts, learns and codes equal pairs of words together. Tables count half bytes: the
nodes of the four bits of one have a row of their own, and one lookup gives what a predictor says of them. The tables have a fixed
size; they are summed by as many tasks as run at once and sent to all tasks.

The most frequent words, at most ``FREQUENT``, are sent to all tasks with their counts; the counts of the others are
joined, word by word, for the base score.

Defined cases: a null text is empty, and an empty text is one end token; repeated rows count and are scored
each by itself; a null key counts as the empty text; without training documents all counts are 0 and every bit has probability 1/2.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.kernel import fold
from tallyfield.llm.text import fields_and, map_pieces, mixed, texts, with_columns
from tallyfield.session import written

FOLDS, HELD_OUT, TUNING = 7, 2, 6
ORDERS, BEFORE = (1, 2, 4, 6), 12
KINDS = len(ORDERS) + 2
#: Columns of a bit's inputs, those after ``KINDS`` empty.
WIDTH = 8
ONES = np.ones(WIDTH, np.float32)
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
ROW = 16
CHUNK = 1 << 13
SURE = 6
GATES = 8 * SURE * SURE
HALF_GATES = GATES // 2
STEPS = 33
ROUNDS, RATE, DAMPING = 3, 0.1, 20.0
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
COUNTED = 400_000
PAIRS = 250_000
BYTES_AT_ONCE, CODED_AT_ONCE, LEARNED_AT_ONCE = 1 << 16, 1 << 12, 1 << 12
CLASSES = 8
BLOCK, SWITCH, SMOOTHING = 16, 0.05, 0.08
END = b""


def class_numbers(docs: DataFrame, classes: str | None) -> tuple[int, Column]:
    """How many classes have tables, at most ``CLASSES``, and the number of a row's class, -1 for any other."""
    number = F.lit(-1)
    if classes is None:
        return 0, number
    known = F.col(classes).isNotNull()
    largest = docs.where(known).groupBy(classes).count().orderBy(F.desc("count"), classes).limit(CLASSES).collect()
    for i, row in enumerate(largest):
        number = F.when(F.col(classes) == row[0], i).otherwise(number)
    return len(largest), number


def count_words(docs: DataFrame, key: str, text: str, classes: str | None) -> DataFrame:
    """(word, tables, tuning, class0, class1, ...): counts of each word, and of the end as the empty
    word, in training documents.
    """
    trained = docs.where(fold(key, FOLDS) != HELD_OUT)
    n_classes, number = class_numbers(trained, classes)
    trained = trained.select(fold(key, FOLDS).alias("_fold"), number.alias("_class"), text)

    def run(batches):
        counts = defaultdict(Counter)

        def out():
            for (tuning, cls), c in counts.items():
                n = pa.array(c.values(), pa.int64())
                same = [pa.array(np.full(len(c), tuning)), pa.array(np.full(len(c), cls, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), *same, n], names=["word", "tuning", "class", "n"])
            counts.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("_fold", "_class"))
            for in_fold, cls, t in zip(*columns, texts(batch, text), strict=True):
                c = counts[in_fold == TUNING, cls]
                c.update(t.encode().lower().split())
                c[END] += 1
                if sum(map(len, counts.values())) > COUNTED:
                    yield from out()
        yield from out()

    rows = trained.mapInArrow(run, "word binary, tuning boolean, class int, n long")
    tables, tuning = F.when(~F.col("tuning"), F.col("n")).otherwise(0), F.when(F.col("tuning"), F.col("n")).otherwise(0)
    of_class = [F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"class{k}") for k in range(n_classes)]
    return rows.groupBy("word").agg(F.sum(tables).alias("tables"), F.sum(tuning).alias("tuning"), *of_class)


def pairs_of(words: list[bytes]) -> list[bytes]:
    """Each word after the end of the word before it and a blank."""
    return list(map(add, [b" ", *(w[-BEFORE:] + b" " for w in words)], words))


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The last 0 to 8 bytes of a number.
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: By order and how many bytes are known: what the order sees of them, and of their number if they are fewer.
_TOLD = {k: _LAST[k] | np.where(np.arange(max(ORDERS) + 1) < k, np.uint64(15 << 56), np.uint64(0)) for k in ORDERS}


def slot_of(contexts: np.ndarray) -> np.ndarray:
    """The first slot of a context's row; the nodes of half a byte have a row of ``ROW`` slots."""
    x = contexts * _SPREAD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x >>= np.uint64(64 - SLOT_BITS)
    x &= np.uint64(SLOTS - ROW)
    return x.view(np.int64)


def contexts_of(pairs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(contexts, data, pair numbers) of all bytes of the pairs' second words and of the blanks after them.

    ``contexts`` has the slots for each predictor where the nodes of a byte are told from.
    """
    lengths = np.fromiter(map(len, pairs), np.int64, len(pairs)) + 1
    data = np.frombuffer(b" ".join(pairs) + b" ", np.uint8)
    starts = np.cumsum(lengths) - lengths
    words = np.flatnonzero(data == 32)[::2] + 1  # a pair has a blank in it, and one after it
    after = starts + lengths - words
    owner = np.repeat(np.arange(len(pairs)), after)
    coded = np.repeat(words - np.cumsum(after) + after, after)
    coded += np.arange(len(owner))
    wide = data.astype(np.uint64)
    last = np.empty_like(wide)  # the bytes before, the last one lowest
    last[0], last[1:] = 0, wide[:-1]
    for back in (1, 2, 4):
        last[back:] |= last[:-back] << np.uint64(8 * back)
    known = np.minimum(coded - np.repeat(starts, after), max(ORDERS))
    last = last.take(coded)
    last &= _LAST.take(known)
    last |= known.view(np.uint64) << np.uint64(56)
    contexts = []
    for k in ORDERS:
        told = _TOLD[k].take(known)
        told &= last
        told += np.uint64(k << 60)
        contexts.append(slot_of(told))
    from_word = np.arange(len(data)) - np.repeat(words, lengths)
    from_word <<= 8
    wide += from_word.view(np.uint64)
    each = mixed(wide)
    total = np.cumsum(each)
    total -= each
    place = (coded - np.repeat(words, after)).view(np.uint64)
    place *= mixed(np.uint64([7]))
    place += total.take(coded)
    contexts.append(slot_of(place - np.repeat(total[words], after)))
    contexts.append(slot_of(place - np.repeat(total[starts] - np.uint64(1 << 56), after)))
    return contexts, data.take(coded), owner


_HALVES = np.arange(ROW)
#: By half byte and place, highest first.
BITS = np.stack([_HALVES >> (3 - d) & 1 for d in range(4)], axis=1).astype(np.float32)
SIGNS = 2 * BITS - 1
_BYTES = np.arange(256)
#: By half and byte: the half, and what leads from the context's row to the slot that stands for this half after the one before it.
HALF = (_BYTES >> 4, _BYTES & 15)
TO_LEAF = (HALF[0], slot_of((_BYTES >> 4).astype(np.uint64) + np.uint64(1)) | HALF[1])


def pair_bytes(pairs: list[bytes], size: int = CODED_AT_ONCE):
    """(rows of each predictor, bytes, pair numbers of the bytes), some bytes after the others."""
    if not pairs:
        return
    contexts, data, owner = contexts_of(pairs)
    for start in range(0, len(data), size):
        part = slice(start, start + size)
        yield [c[part] for c in contexts], data[part], owner[part]


def leaves_of(rows: list[np.ndarray], data: np.ndarray, half: int) -> list[np.ndarray]:
    """The slots that stand for one half of each byte, for each predictor."""
    to = TO_LEAF[half].take(data)
    return [r ^ to for r in rows]


def paths(nodes: np.ndarray, out: np.ndarray) -> None:
    """By slot of a half byte: the values at the four nodes on its way."""
    rows, out = nodes.reshape(-1, ROW), out.reshape(-1, ROW, 4)
    for d in range(4):
        out[..., d] = np.repeat(rows[:, 1 << d : 2 << d], ROW >> d, axis=1)


def batches_of(pairs: list[bytes], size: int = BYTES_AT_ONCE):
    """Slices of ``pairs`` with about ``size`` bytes, one pair at least."""
    ends = np.cumsum(np.fromiter(map(len, pairs), np.int64, len(pairs)))
    start = 0
    while start < len(pairs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield slice(start, stop)
        start = stop


def counted_pairs(batches, text: str):
    """(pairs, counts) of the texts' words, so many pairs at a time as a task holds."""
    counts = Counter()
    for batch in batches:
        for t in texts(batch, text):
            counts.update(pairs_of(t.encode().lower().split()))
            if len(counts) > PAIRS:
                yield list(counts), np.fromiter(counts.values(), np.float32, len(counts))
                counts.clear()
    yield list(counts), np.fromiter(counts.values(), np.float32, len(counts))


class Mixer:
    """Tables, gated weights and map; the size depends on the parameters only."""

    def __init__(self, stretched: np.ndarray, sure: np.ndarray):
        self.stretched, self.sure = stretched, sure
        self.weights = np.full((GATES, KINDS), 0.2, np.float32)
        self.map = None
        self.ways = None

    def __getstate__(self):
        return self.__dict__ | {"ways": None}

    def gathered(self) -> tuple[np.ndarray, np.ndarray]:
        """(stretched, both): by slot, four values as one number; with the gate's parts beside them for the last two predictors."""
        if self.ways is None:
            stretched, both = np.empty((KINDS - 2, SLOTS, 4), np.int8), np.empty((2, SLOTS, 8), np.uint8)
            for k in range(KINDS - 2):
                paths(self.stretched[k], stretched[k])
            for k, step in enumerate((SURE, 1), -2):
                paths(self.stretched[k].view(np.uint8), way := np.empty((SLOTS, 4), np.uint8))
                both[k, :, :4] = way
                paths(self.sure[k] * np.uint8(step), way)
                both[k, :, 4:] = way
            self.ways = stretched.view(np.uint32)[..., 0], both.view(np.uint64)[..., 0]
        return self.ways

    def inputs(self, rows: list[np.ndarray], data: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(stretched probabilities times 16 by predictor, gates within the half) of four bits of each byte."""
        stretched, both = self.gathered()
        *slots, word, before = leaves_of(rows, data, half)
        x = np.zeros((4 * len(data), WIDTH), np.int8)
        for k, (t, at) in enumerate(zip(stretched, slots, strict=True)):
            x[:, k] = t.take(at, mode="wrap").view(np.int8)
        gate = np.full(len(data), _PLACES)
        for k, (t, at) in enumerate(zip(both, (word, before), strict=True), KINDS - 2):
            parts = t.take(at, mode="wrap").view(np.uint32).reshape(-1, 2).T
            x[:, k] = parts[0].copy().view(np.int8)
            gate += parts[1]
        return x.astype(np.float32), gate.view(np.uint8).astype(np.intp)

    def mix(self, x: np.ndarray, gate: np.ndarray, half: int) -> np.ndarray:
        weights = np.zeros((HALF_GATES, WIDTH), np.float32)
        weights[:, :KINDS] = self.weights[half * HALF_GATES : (half + 1) * HALF_GATES] * np.float32(1 / 16)
        parts = weights.take(gate, axis=0, mode="wrap")
        parts *= x
        total = parts @ ONES
        np.maximum(total, np.float32(-12), out=total)
        return np.minimum(total, np.float32(12), out=total)

    @staticmethod
    def step(mixed_: np.ndarray) -> np.ndarray:
        at = mixed_ * np.float32((STEPS - 1) / 16)
        at += np.float32((STEPS - 1) / 2)
        np.maximum(at, np.float32(0), out=at)
        np.minimum(at, np.float32(STEPS - 1), out=at)
        return np.rint(at, out=at).astype(np.intp)

    def learn(self, pairs: list[bytes], counts: np.ndarray) -> None:
        """One online step for each batch of pairs, scaled by the bend of the loss."""
        for some in batches_of(pairs):
            own = counts[some].astype(np.float32)
            for rows, data, owner in pair_bytes(pairs[some], LEARNED_AT_ONCE):
                n = np.repeat(own[owner], 4)
                for half in range(2):
                    x, gate = self.inputs(rows, data, half)
                    bits = BITS.take(HALF[half].take(data), axis=0).ravel()
                    p = sigmoid(self.mix(x, gate, half))
                    squares = (x * x) @ ONES
                    squares *= p
                    squares *= 1 - p
                    squares *= n
                    bend = np.bincount(gate, squares, HALF_GATES) / 256 + DAMPING
                    wrong = bits - p
                    wrong *= n
                    some_weights = self.weights[half * HALF_GATES : (half + 1) * HALF_GATES]
                    for k in range(KINDS):
                        some_weights[:, k] += (RATE / 16 * np.bincount(gate, wrong * x[:, k], HALF_GATES) / bend).astype(np.float32)

    def log10(self, pairs: list[bytes]) -> np.ndarray:
        """log10 probability of each pair's second word and its blank, after the first."""
        out = np.zeros(len(pairs))
        if self.map is not None:  # by half, bit, gate and step
            maps = self.map.reshape(2, 1, HALF_GATES, STEPS)
            maps = np.concatenate([1 - maps, maps], axis=1).astype(np.float32).reshape(2, -1)
        for some in batches_of(pairs):
            for rows, data, owner in pair_bytes(pairs[some]):
                each = np.ones(len(data))
                for half in range(2):
                    x, gate = self.inputs(rows, data, half)
                    m = self.mix(x, gate, half)
                    halves = HALF[half].take(data)
                    p = sigmoid(m * SIGNS.take(halves, axis=0).ravel())
                    if self.map is not None:
                        gate *= STEPS
                        gate += self.step(m)
                        gate += _MAP_SIDES.take(halves, axis=0).ravel()
                        p += maps[half].take(gate, mode="wrap")
                        p *= np.float32(0.5)
                    p = p.reshape(-1, 4)
                    each *= (p[:, 0] * p[:, 1]) * (p[:, 2] * p[:, 3])
                out[some] += np.bincount(owner, np.log10(each), some.stop - some.start)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    p = np.negative(x)
    np.exp(p, out=p)
    p += 1
    return np.reciprocal(p, out=p)


#: The first gate of each place in half a byte, as one number of 4 bytes.
_PLACES = np.uint8(SURE * SURE * np.arange(4)).view(np.uint32)[0]
_MAP_SIDES = BITS.astype(np.intp) * (HALF_GATES * STEPS)


def fit_tables(docs: DataFrame, text: str) -> Mixer:
    """Sum the counts of all contexts of the texts and turn them into predictions."""
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism

    def build(batches):
        leaves = np.zeros((KINDS, SLOTS), np.float32)
        for pairs, counts in counted_pairs(batches, text):
            for some in batches_of(pairs):
                own = counts[some]
                for rows, data, owner in pair_bytes(pairs[some], BYTES_AT_ONCE):
                    n = own[owner]
                    to = [t.take(data) for t in TO_LEAF]
                    for table, row in zip(leaves, rows, strict=True):
                        for t in to:
                            np.add.at(table, row ^ t, n)
        for i, part in enumerate(leaves.reshape(-1, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], names=["chunk", "leaves"])

    def merge(key, rows):
        leaves = np.zeros(CHUNK)
        for part in rows["leaves"]:
            leaves += np.frombuffer(part.as_py(), np.float32)
        z, sure = np.zeros((CHUNK // ROW, ROW), np.int8), np.zeros((CHUNK // ROW, ROW), np.uint8)
        for d in range(4):  # a node's zeros and ones are those of the leaves below it
            below = leaves.reshape(-1, 1 << d, 2, ROW >> (d + 1)).sum(axis=-1)
            zeros, ones = below[..., 0], below[..., 1]
            z[:, 1 << d : 2 << d] = np.clip(np.log((ones + 0.05) / (zeros + 0.05)) * 16, -127, 127)
            sure[:, 1 << d : 2 << d] = np.minimum(np.ceil(np.log2(zeros + ones + 1)), SURE - 1)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "z": [z.tobytes()], "sure": [sure.tobytes()]})

    stretched, sure = np.zeros((KINDS, SLOTS), np.int8), np.zeros((KINDS, SLOTS), np.uint8)
    parts = docs.select(text).coalesce(tasks).mapInArrow(build, "chunk int, leaves binary")
    for row in parts.groupBy("chunk").applyInArrow(merge, "chunk int, z binary, sure binary").collect():
        part = slice(row.chunk * CHUNK, (row.chunk + 1) * CHUNK)
        stretched.reshape(-1)[part] = np.frombuffer(row.z, np.int8)
        sure.reshape(-1)[part] = np.frombuffer(row.sure, np.uint8)
    return Mixer(stretched, sure)


def fit_weights(mixer: Mixer, docs: DataFrame, text: str) -> None:
    """Learn gated weights, then the map, from texts which the tables have not seen."""
    context = docs.sparkSession.sparkContext

    def pairs(batches):
        for some, counts in counted_pairs(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(counts, pa.float32())], names=["pair", "n"])

    tuning = written(docs.select(text).mapInArrow(pairs, "pair binary, n float"), "tuning-pairs")
    tuning = tuning.coalesce(2 * context.defaultParallelism)
    shared = context.broadcast(mixer)
    for _ in range(ROUNDS):

        def learn(batches, weights=mixer.weights):
            own, n = shared.value, 0
            own.weights = weights.copy()
            for batch in batches:
                own.learn(batch.column(0).to_pylist(), batch.column(1).to_numpy())
                n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.weights.tobytes()])], names=["n", "weights"])

        parts = [r for r in tuning.mapInArrow(learn, "n long, weights binary").collect() if r.n]
        if parts:
            learned = [np.frombuffer(r.weights, np.float32).reshape(mixer.weights.shape) for r in parts]
            mixer.weights = np.average(learned, axis=0, weights=[r.n for r in parts]).astype(np.float32)
    weights = mixer.weights

    def counted(batches):
        own = shared.value
        own.weights = weights
        counts = np.zeros((2, 2, HALF_GATES * STEPS))  # by half and bit
        for batch in batches:
            pairs_, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for some in batches_of(pairs_):
                times = n[some]
                for rows, data, owner in pair_bytes(pairs_[some]):
                    weight = np.repeat(times[owner], 4)
                    for half in range(2):
                        x, gate = own.inputs(rows, data, half)
                        at = gate * STEPS + Mixer.step(own.mix(x, gate, half))
                        at += _MAP_SIDES.take(HALF[half].take(data), axis=0).ravel()
                        counts[half] += np.bincount(at, weight, 2 * HALF_GATES * STEPS).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()])], names=["counts"])

    prior = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    zeros, ones = (1 - prior) * 20 + np.zeros((GATES, 1)), prior * 20 + np.zeros((GATES, 1))
    for row in tuning.mapInArrow(counted, "counts binary").collect():
        a, b = np.frombuffer(row.counts).reshape(2, 2, HALF_GATES, STEPS).swapaxes(0, 1).reshape(2, GATES, STEPS)
        zeros, ones = zeros + a, ones + b
    mixer.map = ones / (zeros + ones)


def adapted(ids: list[np.ndarray], coders: np.ndarray, spelled: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each document, given as columns of ``coders``, under coders weighed by how they did so far.

    ``spelled`` has the log10 probability of each word of all documents by the mixed bits. They are one more coder then, and
    spell the words of number -1 for the others.
    """
    lengths = np.array([len(i) for i in ids], np.int64)
    blocks = -(-lengths // BLOCK)
    total = np.zeros(len(ids))
    if not blocks.any():
        return total
    flat = np.concatenate(ids)
    first = np.cumsum(blocks) - blocks
    owner = np.repeat(np.arange(len(ids)), blocks)
    starts = (np.cumsum(lengths) - lengths)[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
    sums = [np.add.reduceat(coder[flat], starts) for coder in coders]
    if spelled is not None:
        others = np.add.reduceat(np.where(flat < 0, spelled, 0.0), starts)
        sums = [s + others for s in sums] + [np.add.reduceat(spelled, starts)]
    sums = np.stack(sums)
    order = np.argsort(-blocks, kind="stable")
    going = np.searchsorted(-blocks[order], -np.arange(blocks.max()), side="left")
    weights = np.full((len(sums), len(ids)), 1 / len(sums))
    for step, n in enumerate(going.tolist()):
        now = order[:n]
        s = sums[:, first[now] + step]
        high = s.max(axis=0)
        each = weights[:, :n] * 10 ** (s - high)
        p = each.sum(axis=0)
        total[now] += high + np.log10(p)
        weights[:, :n] = each / p * (1 - SWITCH) + SWITCH / len(sums)
    return total


class Vocabulary:
    """The frequent words, at most ``FREQUENT`` and none longer than ``FREQUENT_BYTES``, and the coders over them.

    A coder has a column for each of the words and a last one for all other words together.
    """

    def __init__(self, words: DataFrame):
        n = F.col("tables") + F.col("tuning")
        classes = [c for c in words.columns if c.startswith("class")]
        level = F.floor(F.log2(n) * 4).cast("int")
        spelled = words.where(F.length("word") > 0)
        short = F.octet_length("word") <= FREQUENT_BYTES
        sizes = {r.level: r.words for r in spelled.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()}
        taken, least = 0, max(sizes, default=0) + 1
        for at in sorted(sizes, reverse=True):
            taken += sizes[at]
            if taken > FREQUENT:
                break
            least = at
        inside = short & (level >= least)
        rows = spelled.where(inside).select("word", n.alias("n"), *classes).collect()
        self.ids = {bytes(r.word): i for i, r in enumerate(rows)}
        self.counts = np.array([r.n for r in rows] + [0], float)

        outside = spelled.where(~inside).agg(F.sum(n).alias("n"), *(F.sum(c).alias(c) for c in classes)).first()
        once = int((self.counts == 1).sum())

        among = lambda c: np.array([r[c] for r in rows] + [outside[c] or 0], float)
        all_ = among("n")
        all_[-1] += once + 1
        all_ /= all_.sum()
        coders = [all_]
        for c in classes:
            own = among(c)
            if own.sum():
                coders.append(own / own.sum() * (1 - SMOOTHING) + all_ * SMOOTHING)
        if rows:
            coders.append(np.append(all_[:-1] / all_[:-1].sum() / 2, 0.5))
        self.coders = np.log10(np.maximum(np.stack(coders), 1e-300))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: str | None = None) -> DataFrame:
    """Score every whole text; gives ``docs`` without its text, with the columns named below.

    ``classes`` names a column whose largest values, at most ``CLASSES``, have tables of their own. It
    is read for training documents only.
    """
    context = docs.sparkSession.sparkContext
    words = written(count_words(docs, key, text, classes), "word-counts")
    total = words.agg(F.coalesce(F.sum(F.col("tables") + F.col("tuning")), F.lit(0)).alias("n"), F.count("word").alias("v")).first()
    ends = words.where(F.length("word") == 0).agg(F.sum(F.col("tables") + F.col("tuning"))).first()[0] or 0
    end_p = (ends + 1) / (total.n + 2)
    part = fold(key, FOLDS)
    mixer = fit_tables(docs.where(~part.isin(HELD_OUT, TUNING)), text)
    fit_weights(mixer, docs.where(part == TUNING), text)
    vocabulary = Vocabulary(words)
    shared = context.broadcast((mixer, vocabulary.ids, vocabulary.coders, np.log10(vocabulary.counts + 1)))

    def make():
        model, numbers, coders, logs = shared.value

        def work(piece):
            given = [t.encode().lower().split() for t in texts(piece, text)]
            ids = [np.fromiter(map(numbers.get, ws, repeat(-1)), np.int64, len(ws)) for ws in given]
            rest = [Counter(ws[i] for i in np.flatnonzero(at < 0).tolist()) for ws, at in zip(given, ids, strict=True)]
            pairs = [p for ws in given for p in pairs_of(ws)]
            numbered = dict.fromkeys(pairs)
            each = model.log10(list(numbered))
            numbered = dict(zip(numbered, range(len(each)), strict=True))
            spelled = each.take(np.fromiter(map(numbered.__getitem__, pairs), np.intp, len(pairs)))
            lengths = np.array([len(ws) for ws in given], np.int64)
            members = [
                pa.array([w for r in rest for w in r], pa.binary()),
                pa.array([n for r in rest for n in r.values()], pa.int64()),
            ]
            ends_at = np.concatenate([[0], np.cumsum([len(r) for r in rest])])
            return with_columns(
                piece.drop_columns([text]),
                n_tokens=pa.array(lengths + 1),
                n_bytes=pa.array([sum(map(len, ws)) + len(ws) for ws in given], pa.int64()),
                score=pa.array(adapted(ids, coders, spelled) + lengths * np.log10(1 - end_p) + np.log10(end_p)),
                _base=pa.array([float(logs[at].sum()) + float(np.log10(ends + 1)) for at in ids], pa.float64()),
                _known=pa.array([int((at >= 0).sum()) + (ends > 0) for at in ids], pa.int64()),
                _rest=pa.ListArray.from_arrays(
                    pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays(members, names=["word", "times"])
                ),
            )

        return work

    member = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("times", T.LongType())])
    schema = fields_and(
        T.StructType([f for f in docs.schema.fields if f.name != text]),
        n_tokens=T.LongType(), n_bytes=T.LongType(), score=T.DoubleType(), _base=T.DoubleType(), _known=T.LongType(),
        _rest=T.ArrayType(member),
    )
    scored = map_pieces(docs, text, schema, make)
    scored = written(scored.withColumn("_row", F.monotonically_increasing_id()), "word-scores")
    count = F.coalesce(F.col("tables") + F.col("tuning"), F.lit(0))
    rest = (
        scored.select("_row", F.inline("_rest"))
        .join(words.select("word", "tables", "tuning"), "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.col("times") * F.log10(count + 1)).alias("_more"),
            F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("_found"),
        )
    )
    each = float(np.log10(total.n + total.v + 1))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))
    return (
        scored.drop("_rest").join(rest, "_row", "left")
        .withColumn("held_out", fold(key, FOLDS) == HELD_OUT)
        .withColumn("n_known", F.col("_known") + F.coalesce("_found", F.lit(0)))
        .withColumn("train_tokens", F.lit(int(total.n)).cast("long"))
        .withColumn("base_score", F.col("_base") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * each)
        .withColumn("bits_per_byte", bits)
        .drop("_row", "_base", "_known", "_more", "_found")
    )
