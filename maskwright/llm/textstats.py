"""Statistics of a text that need no language."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np

NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "longest_word", "different_words", "top_word", "top_ten_words", "same_as_last_word",
    "upper", "lower", "digits", "spaces", "stops", "marks", "signs", "bars", "non_ascii", "capital_words", "all_upper_words", "marked_words",
    "log_lines", "line_words", "short_lines", "same_lines", "squeezed",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_GROUPS = np.stack([
    _mask(bytes(range(65, 91))), _mask(bytes(range(97, 123))), _mask(b"0123456789"), _mask(b" \t\r\n\x0b\x0c"), _mask(b".,;:"), _mask(b"!?'\"()-"), _mask(b"#$%&*@^~+=<>/\\_{}[]`"), _mask(b"|"), _mask(bytes(range(128, 256))),
], axis=1)


def statistics(text: str) -> list[float]:
    """One number per name; a text without words has zeros wherever a share would be of nothing."""
    raw = text.encode("utf-8", "replace")
    size = max(1, len(raw))
    shares = (np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _GROUPS / size).tolist()
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    top = [c for _, c in counts.most_common(10)]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    capital = upper = marked = 0
    for w, c in counts.items():
        if w.isupper():
            upper += c
        elif w[0].isupper():
            capital += c
        if not w[-1].isalnum():
            marked += c
    lines = text.split("\n")
    again = sum(map(str.__eq__, words, islice(words, 1, None)))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), len(counts) / n, (top or [0])[0] / n, sum(top) / n, again / n,
        *shares, capital / n, upper / n, marked / n,
        float(np.log1p(len(lines))), float(np.log1p(len(words) / len(lines))), sum(len(x) < 20 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / size,
    ]
