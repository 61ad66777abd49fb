"""Suffix order with common-prefix lengths by induced sorting, in whole-array steps.

A text is many segments, each closed by the letter 0, which ends every comparison. Suffixes that
start low between higher neighbours are put in order first; from them one scan upwards induces the
suffixes that fall (type L) and one scan downwards those that rise (type S). What a scan induces waits
in a queue for its first letter and is met there in the order of the rest, so the queues are a priority
queue by (letter, rank of the rest); they hold positions together with the common-prefix length to
the entry before, which is one more than the least such length between the two sources.

The low suffixes are named by a first such pair of scans over what lies between them, and the
reduced text of names is ranked by doubling, as its alphabet is too large for queues.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int16).max
LETTER_BITS, WORD = 9, 7


def falls_or_rises(t: np.ndarray) -> np.ndarray:
    """True for type S: the suffix is below the one after it. End letters count as S."""
    change = np.flatnonzero(t[1:] != t[:-1])
    at = np.searchsorted(change, np.arange(len(t) - 1))
    kind = np.ones(len(t), bool)
    known = at < len(change)
    where = change[at[known]]
    kind[:-1][known] = t[where] < t[where + 1]
    kind[t == 0] = True
    return kind


def words_of(t: np.ndarray) -> np.ndarray:
    """The ``WORD`` letters from each place in one number; letters have at most ``LETTER_BITS`` bits."""
    def after(x, n):
        return np.r_[x[n:], np.zeros(min(n, len(x)), np.uint64)]

    bits = np.uint64(LETTER_BITS)
    one = t.astype(np.uint64)
    two = one << bits | after(one, 1)
    three = two << bits | after(one, 2)
    four = two << (bits * np.uint64(2)) | after(two, 2)
    return four << (bits * np.uint64(3)) | after(three, 4)


def common_prefix(words: np.ndarray, rest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common-prefix length of pairs of suffixes, at most up to the end of a segment."""
    most = np.minimum(rest[a], rest[b])
    out = np.zeros(len(a), np.int64)
    going = np.flatnonzero(most > 0)
    while len(going):
        differ = words[a[going] + out[going]] ^ words[b[going] + out[going]]
        end = np.flatnonzero(differ)
        for n in range(1, WORD):
            out[going[end]] += differ[end] >> np.uint64(LETTER_BITS * (WORD - n)) == 0
        going = going[differ == 0]
        out[going] += WORD
        going = going[out[going] < most[going]]
    return np.minimum(out, most)


class _Scan:
    """One scan: takes batches in order and queues what they induce of one kind."""

    def __init__(self, t: np.ndarray, kind: np.ndarray, letters: int, want: bool, lengths: bool):
        self.t, self.want, self.lengths = t, want, lengths
        # End letters are never induced.
        self.good = (kind == want) & (t > 0)
        self.waiting: list[list] = [[] for _ in range(letters)]
        self.met = np.zeros(letters, bool)
        self.least = np.zeros(letters, np.int16)

    def take(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """All that waits for a letter, in order."""
        parts, self.waiting[letter] = self.waiting[letter], []
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int16)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def feed(self, pos: np.ndarray, common: np.ndarray) -> None:
        before = pos - 1
        source = np.flatnonzero(self.good[before])
        if self.lengths:
            # A letter without a source here takes the least of the whole batch along.
            np.minimum(self.least, common.min(), out=self.least)
        if not len(source):
            return
        letter = self.t[before[source]]
        order = np.argsort(letter, kind="stable")
        source, letter = source[order], letter[order]
        cuts = np.r_[0, np.flatnonzero(letter[1:] != letter[:-1]) + 1, len(letter)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            d, s = int(letter[a]), source[a:b]
            lengths = np.zeros(0, np.int16)
            if self.lengths:
                last = int(s[-1])
                lengths = np.minimum.reduceat(common[: last + 1], np.r_[0, s[:-1] + 1])
                lengths[0] = min(int(lengths[0]), int(self.before[d]))
                lengths = np.minimum(lengths, NONE - 1) + np.int16(1)
                if not self.met[d]:
                    lengths[0] = 0
                self.least[d] = common[last + 1 :].min(initial=NONE)
            self.met[d] = True
            self.waiting[d].append((before[s], lengths))

    def run(self, pos: np.ndarray, common: np.ndarray) -> None:
        if len(pos):
            self.before = self.least.copy()
            self.feed(pos, common)


def _first_length(words, rest, a: int, b: int) -> int:
    return int(common_prefix(words, rest, np.array([a]), np.array([b]))[0])


def induce(t: np.ndarray, kind: np.ndarray, words: np.ndarray, rest: np.ndarray, seeds: np.ndarray, common: np.ndarray | None):
    """Order all suffixes by the order of the seeds: for each letter (L part, S part) with lengths.

    ``seeds`` are the low positions in the order of their letters, end letters first. Without
    ``common`` no lengths are carried, and seeds of one letter may be in any order.
    """
    lengths = common is not None
    common = common if lengths else np.zeros(len(seeds), np.int16)
    letters = int(t.max(initial=0)) + 1
    bounds = np.searchsorted(t[seeds], np.arange(letters + 1))
    up = _Scan(t, kind, letters, False, lengths)
    falling = []
    for c in range(letters):
        parts = []
        while up.waiting[c]:
            batch = up.take(c)
            up.run(*batch)
            parts.append(batch)
        pos = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int32)
        com = np.concatenate([q for _, q in parts]) if parts and lengths else np.zeros(0, np.int16)
        falling.append((pos, com))
        low, low_common = seeds[bounds[c] : bounds[c + 1]], common[bounds[c] : bounds[c + 1]].copy()
        if lengths and len(low):
            low_common[0] = _first_length(words, rest, pos[-1], low[0]) if len(pos) else 0
        up.run(low, low_common)
    down = _Scan(t, kind, letters, True, lengths)
    rising = []
    for c in range(letters - 1, 0, -1):
        parts = []
        while down.waiting[c]:
            batch = down.take(c)
            down.run(*batch)
            parts.append(batch)
        pos = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int32)
        com = np.concatenate([q for _, q in parts]) if parts and lengths else np.zeros(0, np.int16)
        fall, fall_common = falling[c]
        between = 0
        if lengths and len(pos) and len(fall):
            between = _first_length(words, rest, fall[-1], pos[-1])
        back = np.r_[np.int16(between), fall_common[:0:-1]] if lengths and len(fall) else np.zeros(len(fall), np.int16)
        down.run(fall[::-1], back)
        # Upwards each entry is compared with the one below it.
        upward = np.r_[np.int16(between), com[:0:-1]] if lengths and len(pos) else np.zeros(len(pos), np.int16)
        rising.append((pos[::-1], upward))
    return falling[1:], rising[::-1]


def _names(t: np.ndarray, low: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers in ``order`` for the stretches from each low position to the next; equal ones share one."""
    a, b = order[:-1], order[1:]
    size = end - low
    differ = size[a] != size[b]
    going = np.flatnonzero(~differ)
    step = 0
    while len(going):
        unequal = t[low[a[going]] + step] != t[low[b[going]] + step]
        differ[going[unequal]] = True
        going = going[~unequal]
        step += 1
        going = going[size[a[going]] >= step]
    names = np.empty(len(order), np.int64)
    names[order] = np.r_[0, np.cumsum(differ)]
    return names


def ranked(names: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a reduced text; ``left`` counts the names up to its segment's end."""
    n, step = len(names), 1
    rank, found = names, int(names.max(initial=0)) + 1
    order = np.argsort(rank, kind="stable")
    while step <= int(left.max(initial=0)) and found < n:
        second = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= step)
        second[inside] = rank[inside + step] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if int(new[-1]) + 1 == found and step > 1:
            break
        found, step = int(new[-1]) + 1, step * 2
    return order


def suffix_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, lengths): all suffixes but the end letters in order, and what each shares with the one before.

    ``t`` has letters from 0, which ends each segment and the text, to 2^9 - 1; a segment has from one letter
    to some thousands.
    """
    ends = np.flatnonzero(t == 0)
    rest = ends[np.searchsorted(ends, np.arange(len(t)))] - np.arange(len(t))
    kind = falls_or_rises(t)
    low = np.flatnonzero(kind & np.r_[False, ~kind[:-1]]).astype(np.int32)
    loose = low[np.argsort(t[low], kind="stable")]
    words = words_of(t)
    _, rising = induce(t, kind, words, rest, loose, None)
    is_low = np.zeros(len(t), bool)
    is_low[low] = True
    closing = t[low] == 0
    in_order = np.concatenate([low[closing], *(p[is_low[p]] for p, _ in rising)])
    number = np.empty(len(t), np.int32)
    number[low] = np.arange(len(low))
    end = np.r_[low[1:], low[-1:]]
    end[closing] = low[closing]
    names = _names(t, low, end, number[in_order])
    close_at = np.flatnonzero(closing)
    left = close_at[np.searchsorted(close_at, np.arange(len(low)))] - np.arange(len(low))
    seeds = low[ranked(names, left)]
    common = np.zeros(len(seeds), np.int16)
    common[1:] = common_prefix(words, rest, seeds[:-1], seeds[1:])
    falling, rising = induce(t, kind, words, rest, seeds, common)
    parts = [part for both in zip(falling, rising, strict=True) for part in both]
    return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
