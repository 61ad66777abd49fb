"""Statistics of whole texts, computed per text from its bytes, words and lines."""

from __future__ import annotations

import numpy as np

from tallyfield.llm.text import BLANKS

# Fixed value: the characters that the quality rules count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The features of the two quality models. All are shares, logarithms or means, so that texts of
#: any length compare; an empty text has zeros.
FEATURES = (
    "log_words",
    "mean_word",
    "sd_word",
    "symbol_share",
    "upper_share",
    "digit_share",
    "stop_share",
    "comma_share",
    "bang_share",
    "other_ascii_share",
    "high_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "log_line_words",
    "byte_entropy",
    "long_word_share",
    "punctuated_lines",
)

_KINDS = np.zeros((256, 9))
for _byte in range(256):
    _c = chr(_byte)
    _kind = (
        8 if _byte < 128 and _c in BLANKS
        else 0 if _byte in SYMBOLS
        else 1 if "A" <= _c <= "Z"
        else 2 if "0" <= _c <= "9"
        else 3 if _c == "."
        else 4 if _c == ","
        else 5 if _c in "!?"
        else 7 if _byte >= 128
        else 6
    )
    if not "a" <= _c <= "z":
        _KINDS[_byte, _kind] = 1


def repeated_words(ids: np.ndarray) -> int:
    """How many words lie in 3-word windows found twice or more in the text."""
    if ids.size < 6 and ids.size < 4:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    _, pairs = np.unique(ids[:-1].astype(np.int64) * ids.size + ids[1:], return_inverse=True)
    windows = pairs[:-1].astype(np.int64) * ids.size + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(ids.size, bool)
    for shift in range(3):
        covered[shift : shift + again.size] |= again
    return int(covered.sum())


def duplicate_lines(lines: list[str]) -> int:
    """How many lines that hold a word equal an earlier line."""
    worded = [line for line in lines if line.strip(BLANKS)]
    return len(worded) - len(set(worded))


def text_stats(text: str) -> tuple[tuple[int, ...], list[float]]:
    """The counts of ``COUNTS`` and the values of ``FEATURES`` for a text."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, digits, stops, commas, bangs, other, high, blanks = (seen @ _KINDS).tolist()
    n, chars = len(words), len(text) - int(blanks)
    lines = text.split("\n")
    ids: dict[bytes, int] = {}
    numbered = np.array([ids.setdefault(w, len(ids)) for w in words])
    dup_lines, repeats = duplicate_lines(lines), repeated_words(numbered)
    lengths = np.array([len(w) for w in words], float)
    share = seen[seen > 0] / len(raw)
    counts = (n, chars, int(symbols), dup_lines, repeats)
    return counts, [
        float(np.log1p(n)),
        chars / n,
        float(lengths.std()),
        symbols / len(raw),
        upper / len(raw),
        digits / len(raw),
        stops / n,
        commas / n,
        bangs / n,
        other / len(raw),
        high / len(raw),
        dup_lines / len(lines),
        repeats / n,
        len(ids) / n**0.8,
        float(np.log1p(n / len(lines))),
        float(-(share * np.log2(share)).sum()),
        float((lengths > 15).mean()),
        sum(line.rstrip(BLANKS).endswith((".", "!", "?")) for line in lines) / len(lines),
    ]
