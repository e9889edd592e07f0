"""Counts over whole texts that quality operators share; plain functions for use within tasks."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: The blanks that separate words, and the symbols that are counted.
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found at least twice, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    codes, taken = ids, 1
    while taken < width:
        # windows grow by a word at a time; ranking them keeps the numbers small enough to be exact
        nxt = ids[taken : taken + len(codes) - 1]
        joint = codes[: len(nxt)] * len(number) + nxt
        taken += 1
        codes = joint if taken == width or joint.max(initial=0) < (1 << 62) // len(number) else np.unique(joint, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of a text."""
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def shape(text: str, counts: tuple[int, int, int, int, int]) -> list[float]:
    """Size-free statistics of a text for classifiers: shares and means, zero for an empty text."""
    n_words, word_chars, symbols, dup_lines, repeat = counts
    size = max(len(text), 1)
    words = max(n_words, 1)
    lines = text.count("\n") + 1
    data = text.encode()
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6)
    whole = max(len(data), 1)
    lengths = Counter(map(len, data.split()))
    mean = sum(k * v for k, v in lengths.items()) / words
    spread = (sum((k - mean) ** 2 * v for k, v in lengths.items()) / words) ** 0.5
    return [
        np.log1p(n_words), word_chars / words, symbols / size, dup_lines / lines, repeat / words,
        kinds[0] / whole, kinds[1] / whole, kinds[2] / whole, kinds[3] / whole, kinds[4] / whole, kinds[5] / whole,
        text.count("!") / words, text.count("|") / words, text.count(".") / words, text.count(",") / words,
        np.log1p(size / lines), mean, spread, sum(v for k, v in lengths.items() if k > 20) / words, sum(v for k, v in lengths.items() if k <= 2) / words,
    ]


SHAPE_NAMES = (
    "words", "word_length", "symbols", "duplicate_lines", "repeats", "other", "lower", "upper", "digits", "punctuation", "beyond_ascii",
    "exclamations", "bars", "stops", "commas", "line_length", "word_bytes", "word_spread", "long_words", "short_words",
)
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_KIND[128:] = 5
