"""Byte-pair encoding with a segment tree over adjacent pair ranks, and decoding.

A text is cut by the tokenizer's pattern. In each piece the leaves of a segment tree hold the
rank of the pair that starts there; the root is the leftmost pair of lowest rank. Merging it
changes three leaves and their ancestors, and merging ends when the root holds no pair. Pieces
of like length are merged together: their trees are the rows of one numpy array.

Defined cases: a null text is encoded as the empty text (no ids, decoded to the empty text);
texts are encoded whole, however long; an added token of the file, where its string stands in a
text, becomes its own id, as the tokenizers library does unless told otherwise; other columns
pass through, and a column with an output's name is replaced. Unknown ids raise.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyfield.llm.text import fields_and, map_pieces, texts, with_columns

# Fixed value: the pattern by which byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEPT_PIECES = 250_000
KEPT_LENGTH = 64
TREE_CELLS = 1 << 19
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary, as letter to byte.

    Visible Latin-1 characters stand for themselves; the other bytes take letters from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The merges of a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = byte_letters()
        self.first = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in s) for s, i in vocab.items()
        } | {i: s.encode() for s, i in self.added.items()}
        self.split = re.compile(
            "(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")"
        ) if self.added else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                by_width.setdefault(1 << max(1, (len(w) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, TREE_CELLS // width)
            for start in range(0, len(rows), step):
                chosen = rows[start : start + step]
                for i, ids in zip(chosen, self._merge([words[i] for i in chosen], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
        lengths = np.array([len(w) for w in words])
        places = np.arange(width)
        token = np.where(places < lengths[:, None], self.first[raw].reshape(count, width), -1)
        after = np.broadcast_to(places + 1, (count, width)).copy()
        before = np.broadcast_to(places - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), NONE)
        ranks = self.pair_ranks(token[:, :-1], token[:, 1:])
        real = (ranks < NONE) & (token[:, 1:] >= 0)
        tree[:, width : 2 * width - 1] = np.where(real, ranks * width + places[:-1], NONE)
        low = width
        while low > 1:
            half = low >> 1
            tree[:, half:low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low = half
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            root = tree[rows, 1]
            at, rank = root % width, root // width
            gone = after[rows, at]
            token[rows, at] = self.merged[rank]
            token[rows, gone] = -1
            behind = after[rows, gone]
            after[rows, at] = behind
            inner = behind < lengths[rows]
            before[rows[inner], behind[inner]] = at[inner]
            self._set(tree, rows, gone, width, np.full(rows.size, NONE))
            follow = np.where(inner, token[rows, np.minimum(behind, width - 1)], -1)
            self._set(tree, rows, at, width, self._leaf(token[rows, at], follow, at, width))
            ahead = before[rows, at]
            led = ahead >= 0
            r, p = rows[led], ahead[led]
            self._set(tree, r, p, width, self._leaf(token[r, p], token[r, at[led]], p, width))
            rows = rows[tree[rows, 1] < NONE]
        kept = token >= 0
        packed = token[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        starts = np.concatenate([[0], ends[:-1]])
        return [packed[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _leaf(self, left, right, place, width):
        rank = self.pair_ranks(left, np.maximum(right, 0))
        return np.where((right >= 0) & (rank < NONE), rank * width + place, NONE)

    @staticmethod
    def _set(tree, rows, places, width, values):
        """Set one leaf of each row and renew its ancestors."""
        node = places + width
        tree[rows, node] = values
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


@functools.lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Encodes texts; keeps the ids of short pieces met before, up to a bounded number."""

    def __init__(self, path: str):
        self.merges = merges_of(path)
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self.added = {s: np.uint32(i).astype("<u4").tobytes() for s, i in self.merges.added.items()}

    def cut(self, text: str) -> list[str]:
        if self.merges.split is None or not any(s in text for s in self.added):
            return self.pattern.findall(text)
        parts = self.merges.split.split(text)
        return list(chain.from_iterable(
            [part] if i % 2 else self.pattern.findall(part) for i, part in enumerate(parts)
        ))

    def encode(self, given: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        known = self.known
        known.update(self.added)
        cuts = [self.cut(t) for t in given]
        new = list(set(chain.from_iterable(cuts)).difference(known))
        for piece, ids in zip(new, self.merges.encode([p.encode() for p in new]), strict=True):
            known[piece] = ids
        out = [b"".join(map(known.__getitem__, cut)) for cut in cuts]
        for piece in new:
            if len(piece) > KEPT_LENGTH:
                del known[piece]
        return out


def encode_bpe(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens`` and ``token_ids``: the ids packed as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file that every executor has installed.
    """
    added = {"n_tokens": T.LongType(), "token_ids": T.BinaryType()}

    def make():
        encoder = Encoder(vocabulary)

        def work(piece):
            ids = encoder.encode(texts(piece, text))
            return with_columns(
                piece,
                n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
                token_ids=pa.array(ids, pa.binary()),
            )

        return work

    return map_pieces(df, text, fields_and(df.schema, **added), make)


def decode_bpe(df: DataFrame, vocabulary: str, token_ids: str = "token_ids") -> DataFrame:
    """Add ``decoded``: the text of packed ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""

    def make():
        table = merges_of(vocabulary).bytes

        def work(piece):
            decoded = [
                b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                for x in piece.column(token_ids).to_pylist()
            ]
            return with_columns(piece, decoded=pa.array(decoded, pa.string()))

        return work

    return map_pieces(df, token_ids, fields_and(df.schema, decoded=T.StringType()), make)
