import random

import numpy as np
import pytest

from tallyfield.llm.suffixes import suffix_order


def brute(segments):
    t = [x for s in segments for x in [*s, 0]]
    ends, end = {}, None
    for i in range(len(t) - 1, -1, -1):
        end = i if t[i] == 0 else end
        ends[i] = end
    suffixes = sorted((tuple(t[i : ends[i]]), i) for i in range(len(t)) if t[i])
    lengths = [0]
    for (a, _), (b, _) in zip(suffixes, suffixes[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lengths.append(n)
    return t, suffixes, lengths


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_orders_and_common_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(150):
        segments = [[rng.randint(1, letters) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 8))]
        segments += segments[: rng.randint(0, 3)]
        t, suffixes, lengths = brute(segments)
        pos, common = suffix_order(np.array(t, np.uint16))
        ends = np.flatnonzero(np.array(t) == 0)
        seen = [tuple(t[p : ends[np.searchsorted(ends, p)]]) for p in pos]
        assert seen == [s for s, _ in suffixes]
        assert sorted(pos.tolist()) == sorted(i for _, i in suffixes)
        assert common.tolist() == lengths


def test_long_runs_of_one_letter():
    segments = [[2] * 150, [2] * 150, [2] * 120 + [1], [2] * 120 + [3], [1] * 140 + [2] * 9]
    t, suffixes, lengths = brute(segments)
    assert suffix_order(np.array(t, np.uint16))[1].tolist() == lengths
