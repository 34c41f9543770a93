"""Sparse features of a text for the classifiers: hashed words, and hashed shapes and habits of writing."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

WORDS = 4096
SHAPES = 1024
#: Words in each block of which the distinct share is taken.
BLOCK_WORDS = 200
_CLASS = bytes(
    0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+")


def _level(part: float) -> int:
    """A part of 0 to 1 on a scale that is finer towards 0."""
    return int(np.sqrt(min(max(part, 0.0), 1.0)) * 10)


def distinct_share(words: list[bytes]) -> float:
    """The mean share of distinct words over all blocks of BLOCK_WORDS words; the last block ends with the text."""
    n = len(words)
    last = max(n - BLOCK_WORDS, 0)
    shares = [len(set(words[i : i + BLOCK_WORDS])) / max(min(n, BLOCK_WORDS), 1) for i in [*range(0, last, BLOCK_WORDS), last]]
    return sum(shares) / len(shares)


def shape_terms(raw: bytes, words: list[bytes]) -> Counter:
    """Counts of word shapes (letters, capitals, digits and marks, runs shortened) and of levels of a few ratios."""
    shapes = Counter(_RUN.sub(rb"\1", raw.translate(_CLASS)).split())
    n = len(words)
    again = sum(map(bytes.__eq__, words[1:], words)) if n > 1 else 0
    lines = raw.splitlines()
    marks = len(raw) - sum(map(len, words)) if n else 0
    capitals = sum(c for s, c in shapes.items() if b"A" in s and b"a" not in s)
    terms = Counter(shapes)
    for name, part in (
        (b"#again", again / max(n, 1)),
        (b"#same lines", 1 - len(set(lines)) / max(len(lines), 1)),
        (b"#capital words", capitals / max(n, 1)),
        (b"#white", marks / max(len(raw), 1)),
        (b"#short", 1 / (1 + n)),
        (b"#distinct", distinct_share(words)),
    ):
        terms[name + b"%d" % _level(part)] += max(1, n // 8)
    return terms


def hashed(terms: Counter, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (distinct, rising) and log(1 + count) of terms hashed to size columns."""
    if not terms:
        return np.empty(0, np.int64), np.empty(0)
    at = np.fromiter((zlib.crc32(t) % size for t in terms), np.int64, len(terms))
    total = np.bincount(at, np.fromiter(terms.values(), np.float64, len(terms)), size)
    columns = np.flatnonzero(total)
    return columns, np.log1p(total[columns])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: words in 0..WORDS-1, shapes after them; both parts have length 1."""
    raw = (text or "").encode()
    words = raw.split()
    parts = []
    for terms, size, start in ((Counter(raw.lower().split()), WORDS, 0), (shape_terms(raw, words), SHAPES, WORDS)):
        columns, values = hashed(terms, size)
        parts.append((columns + start, values / (np.linalg.norm(values) or 1.0)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
