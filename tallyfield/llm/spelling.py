"""Spelling variants: words one code point apart, found in a trie of letter-group counts.

A word is told by how often each group of letters occurs in it: first four coarse groups, then the
fine groups that each coarse one is made of. Groups are balanced by the letters of the vocabulary
itself. One inserted, deleted or replaced letter adds one to one count, takes one from one count, or
both, so a search that goes down the trie may spend one surplus and one deficit, the deficit of a
replacement in a coarse group chosen at the top. Words at the leaves are compared letter by letter.

The coarse levels are the shuffle key: a word lies in the cell of its own coarse counts and goes as a
question to the cells one surplus, or one surplus and a later deficit, away. So each pair with
different coarse counts is met once. The fine levels are walked inside a cell by all questions
of a batch at a time. Cells with more than ``CELL_WORDS`` words are split, and questions go to each
part; questions stream past the words of a part.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; these letters are one
byte each in Latin-1. ``damage`` deletes one letter of those runs whose hash with the document says so.

Defined cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count
again; other columns are not read. No words give an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfield.llm.text import pieces, texts
from tallyfield.session import written

# The runs of letters, and the rule that picks those to be damaged.
RUN = "[A-Za-zÀ-ÿ]+"
DAMAGE_DIVISOR = 97
MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 5, 3, 2

COARSE, FINE = 4, 4
CELL_WORDS = 20_000
#: Words that a task holds, on average, while questions pass.
TASK_WORDS = 20_000
COUNTER_WORDS = 200_000
BATCH = 8_192
#: Words up to this length are compared side by side in one array, longer ones two by two.
WIDTH = 40
ALL = (1 << COARSE) - 1

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def count_words(docs: DataFrame, text: str, key: str, min_length: int, damage: bool) -> DataFrame:
    """(word, n): how often each word of ``min_length`` letters or more occurs in all texts."""
    find = re.compile(RUN).findall

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
        )

    def run(batches):
        counts = Counter()
        for batch in batches:
            for piece in pieces(batch, text):
                for doc, t in zip(piece.column(key).to_pylist(), texts(piece, text), strict=True):
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    lowered = Counter(find(t.encode().translate(_LOWER).decode()))
                    for word, n in lowered.items():
                        if damage:
                            h = zlib.crc32(word.encode(), seed)
                            if h % DAMAGE_DIVISOR == 0:
                                cut = h % len(word)
                                word = word[:cut] + word[cut + 1 :]
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) > COUNTER_WORDS:
                    yield flush(counts)
                    counts = Counter()
        yield flush(counts)

    return (
        docs.select(key, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )


def letter_groups(words: DataFrame) -> np.ndarray:
    """For each Latin-1 letter its fine group; group g is part of coarse group g // FINE.

    Letters go, the commonest first, to the group that holds the fewest so far; coarse groups are
    filled first, then the fine groups of each. At most as many rows as there are letters.
    """

    def count(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            joined = "".join(batch.column("word").to_pylist()).encode("latin-1")
            total += np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["letter", "n"])

    counted = (
        words.select("word").mapInArrow(count, "letter long, n long")
        .groupBy("letter").agg(F.sum("n").alias("n")).collect()
    )
    coarse, fine = np.zeros(COARSE), np.zeros((COARSE, FINE))
    group = np.zeros(256, np.int64)
    for row in sorted(counted, key=lambda r: (-r.n, r.letter)):
        c = int(coarse.argmin())
        f = int(fine[c].argmin())
        coarse[c] += row.n
        fine[c, f] += row.n
        group[row.letter] = c * FINE + f
    return group


def _strides() -> np.ndarray:
    """Odd numbers by which coarse counts add up to a cell's number."""
    return np.random.default_rng(13).integers(1, 1 << 62, COARSE, np.int64) | 1


def group_counts(words: list[bytes], group: np.ndarray) -> np.ndarray:
    """Counts of the fine groups, one row a word."""
    letters = np.frombuffer(b"".join(words), np.uint8)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    width = COARSE * FINE
    return np.bincount(owner * width + group[letters], minlength=len(words) * width).reshape(-1, width)


def _cells(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word's cell, and its coarse counts."""
    coarse = counts.reshape(-1, COARSE, FINE).sum(axis=2)
    with np.errstate(over="ignore"):
        return (coarse * _strides()).sum(axis=1), coarse


def ask(words: DataFrame, group: np.ndarray) -> DataFrame:
    """(cell, up, down, word, n): each word for its own cell and for those it asks.

    ``up`` and ``down`` are the coarse groups, as bits, in which a surplus and a deficit may be spent;
    a row with ``up`` null lies in the cell.
    """
    strides = _strides()
    ways = [(0, None, None), (0, ALL, ALL)]
    ways += [(1 << i, 1 << i, 0) for i in range(COARSE)]
    ways += [(None, 1 << i, 1 << j) for i in range(COARSE) for j in range(i + 1, COARSE)]
    bit = {1 << i: i for i in range(COARSE)}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            cell, coarse = _cells(group_counts(encoded, group))
            for at, up, down in ways:
                keep = np.ones(len(cell), bool)
                with np.errstate(over="ignore"):
                    to = cell if at == 0 else cell + strides[bit[up]]
                    if at is None:
                        keep = coarse[:, bit[down]] > 0
                        to = to - strides[bit[down]]
                rows = pa.array(np.flatnonzero(keep))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to[keep]),
                        pa.array([up] * n, pa.int32()),
                        pa.array([down] * n, pa.int32()),
                        batch.column("word").take(rows),
                        batch.column("n").take(rows),
                    ],
                    names=["cell", "up", "down", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "cell long, up int, down int, word string, n long")


class Trie:
    """Words of some cells, arranged by cell and then by fine group after fine group."""

    def __init__(self, cells: np.ndarray, words: list[bytes], n: np.ndarray, group: np.ndarray):
        counts = group_counts(words, group)
        order = np.lexsort([*counts.T[::-1], cells])
        self.words = [words[i] for i in order]
        self.n, cells, counts = n[order], cells[order], counts[order]
        new = np.r_[True, cells[1:] != cells[:-1]]
        self.cells = cells[new]
        node = np.cumsum(new) - 1
        # A child is known by its parent and count. Children lie in that order, so each level is a sorted array.
        self.levels = []
        self.span = int(counts.max(initial=0)) + 3
        for column in counts.T:
            known = node * self.span + column
            new = np.r_[True, known[1:] != known[:-1]]
            self.levels.append(known[new])
            node = np.cumsum(new) - 1
        self.first = np.r_[np.flatnonzero(new), len(node)]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def search(self, cells: np.ndarray, counts: np.ndarray, up: np.ndarray, down: np.ndarray):
        """(question, word) numbers at the leaves that the questions reach."""
        node, here = self._find(self.cells, cells)
        who = np.flatnonzero(here)
        node, up, down = node[who], up[who], down[who]
        for level, table in enumerate(self.levels):
            bit = np.int64(1 << (level // FINE))
            wanted = counts[who, level]
            inside = wanted < self.span - 1
            plus = np.flatnonzero(((up & bit) > 0) & inside)
            minus = np.flatnonzero(((down & bit) > 0) & (wanted > 0) & (wanted < self.span))
            same = np.flatnonzero(inside)
            # Without a choice made at the top, what is added must be taken from the same coarse group.
            free_down = np.where(down[plus] == ALL, bit, down[plus])
            free_up = np.where(up[minus] == ALL, bit, up[minus])
            keys = node * self.span + wanted
            keys = np.concatenate([keys[same], keys[plus] + 1, keys[minus] - 1])
            came = np.concatenate([same, plus, minus])
            up = np.concatenate([up[same], np.zeros(len(plus), np.int64), free_up])
            down = np.concatenate([down[same], free_down, np.zeros(len(minus), np.int64)])
            at, found = self._find(table, keys)
            node, who, up, down = at[found], who[came[found]], up[found], down[found]
        sizes = self.first[node + 1] - self.first[node]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(who, sizes), np.arange(sizes.sum()) - np.repeat(starts - self.first[node], sizes)


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)
    while low < high:  # the length of the common beginning
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words from the left and from the right in arrays of ``WIDTH`` letters, cut if longer."""
    left = b"".join(w[:WIDTH].ljust(WIDTH, b"\0") for w in words)
    right = b"".join(w[-WIDTH:].rjust(WIDTH, b"\0") for w in words)
    return (np.frombuffer(x, np.uint8).reshape(-1, WIDTH) for x in (left, right))


def verified(asked: list[bytes], words: list[bytes], q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which pairs are one letter apart."""
    a_size = np.fromiter(map(len, asked), np.int64, len(asked))
    b_size = np.fromiter(map(len, words), np.int64, len(words))
    a_left, a_right = _padded(asked)
    b_left, b_right = _padded(words)
    near = np.zeros(len(q), bool)
    for start in range(0, len(q), 1 << 16):
        s = slice(start, start + (1 << 16))
        x, y = q[s], w[s]
        front = (np.c_[a_left[x] != b_left[y], np.ones(len(x), bool)]).argmax(axis=1)
        back = (np.c_[(a_right[x] != b_right[y])[:, ::-1], np.ones(len(x), bool)]).argmax(axis=1)
        longer = np.maximum(a_size[x], b_size[y])
        apart = (front + back >= longer - 1) & (abs(a_size[x] - b_size[y]) <= 1)
        differ = (a_size[x] != b_size[y]) | (front < longer)
        near[s] = apart & differ
        for i in np.flatnonzero(longer > WIDTH):
            near[start + i] = one_apart(asked[x[i]], words[y[i]])
    return near


NEAR = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())]
)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words that are one letter apart, both ways."""
    group = letter_groups(words)
    rows = written(ask(words, group), "spelling-asked")
    sizes = rows.where(F.col("up").isNull()).groupBy("cell").agg(F.count(F.lit(1)).alias("_size"))
    total = words.count()
    tasks = max(4 * words.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_WORDS))
    # A part of a cell is a cell of its own, known by a number of its own.
    parts = F.ceil(F.col("_size") / CELL_WORDS).cast("int")
    mine = F.array(F.pmod(F.xxhash64("word"), parts).cast("int"))
    every = F.sequence(F.lit(0), parts - 1)
    dealt = rows.join(sizes, "cell").select(
        "cell", "up", "down", "word", "n", F.explode(F.when(F.col("up").isNull(), mine).otherwise(every)).alias("_part")
    ).withColumn("cell", F.xxhash64("cell", "_part"))
    # The words of a task's cells come first, then the questions stream past them.
    come = dealt.drop("_part").repartition(tasks, "cell").sortWithinPartitions(F.col("up").isNotNull())

    def walk(batches):
        cells, lying, counted, trie = [], [], [], None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                up = part.column("up")
                first = int(pc.sum(up.is_null()).as_py())
                words_in = [x.encode("latin-1") for x in part.column("word").to_pylist()]
                cell, n = part.column("cell").to_numpy(), part.column("n").to_numpy()
                if first:
                    cells.append(cell[:first])
                    counted.append(n[:first])
                    lying += words_in[:first]
                if first == part.num_rows or not lying:
                    continue
                trie = trie or Trie(np.concatenate(cells), lying, np.concatenate(counted), group)
                asked, n = words_in[first:], n[first:]
                up = up[first:].to_numpy().astype(np.int64)
                down = part.column("down")[first:].to_numpy().astype(np.int64)
                q, w = trie.search(cell[first:], group_counts(asked, group), up, down)
                good = verified(asked, trie.words, q, w)
                q, w = q[good], w[good]
                # Inside one cell both words ask; elsewhere only one does, and both rows are due.
                back = np.flatnonzero(up[q] != ALL)
                mine = [asked[i].decode("latin-1") for i in q]
                other = [trie.words[i].decode("latin-1") for i in w]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mine + [other[i] for i in back], pa.string()),
                        pa.array(other + [mine[i] for i in back], pa.string()),
                        pa.array(np.r_[trie.n[w], n[q[back]]].astype(np.int64)),
                    ],
                    names=["word", "near", "near_n"],
                )

    return come.mapInArrow(walk, NEAR)


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the last word that forms lead to.

    Each round doubles the length of the steps, and a form is at least twice as frequent as its word,
    so the rounds are few and no chain is a ring.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-steps")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        longer = written(
            steps.join(ahead, "root", "left").select(
                "word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")
            ),
            "spelling-steps",
        )
        steps = longer.select("word", "root")
        if longer.where("_moved").isEmpty():
            return steps


def spelling_variants(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, factor: float = FORM_FACTOR, damage: bool = False,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each frequent word, its likeliest spelling and their root.

    A word's form is its near word of largest n, the smallest of equals, if that is at least
    ``factor`` times its own n.
    """
    words = written(
        count_words(docs, text, key, min_length, damage).where(F.col("n") >= min_count), "spelling-words"
    )
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_best"),
    )
    large = -F.col("_best.m") >= F.lit(factor) * F.col("n")
    judged = written(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("_best.w")).alias("form"),
            F.when(large, -F.col("_best.m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = follow(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
