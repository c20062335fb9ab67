"""Hashed word shingles of many texts at once, in flat numpy arrays.

Words are stretches of ASCII letters and digits and of characters outside
ASCII, lower-cased; everything else separates.  A text with fewer words than a
shingle has is one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    in_word = _WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], in_word]).astype(np.int8)))
    if len(edge) % 2:
        edge = np.append(edge, len(b))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([[U(0)], np.cumsum((b.astype(np.uint64) + U(1)) * _powers(_P, len(b)),
                                              dtype=np.uint64)])
    h = (total[end] - total[start]) * _powers(_P_INVERSE, len(b) + 1)[start]
    first = np.cumsum([0] + [len(x) + 1 for x in raw])
    return mix(h ^ ((end - start).astype(np.uint64) << U(48))), np.searchsorted(first, start, "right") - 1


def shingles(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of n words, in order of the texts."""
    w, doc = words(texts)
    counts = np.bincount(doc, minlength=len(texts))
    if len(w) >= n:
        m = len(w) - n + 1
        h = w[:m].copy()
        for k in range(1, n):
            h = mix(h * _P + w[k:k + m])
        whole = doc[:m] == doc[n - 1:]
        h, at = h[whole], doc[:m][whole]
    else:
        h, at = w[:0], doc[:0]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.cumsum(counts) - counts
        rest = np.full(len(short), 0, np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            rest[has] = mix(rest[has] * _P + w[first[short[has]] + k] + U(k + 1))
        h, at = np.concatenate([h, rest]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def units(texts: list[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shingles as sets: the c-th time a shingle occurs is an element of its own.

    The Jaccard similarity of these sets is the weighted one of the shingles,
    with their counts as weights.  Sorted by text, then hash.
    """
    h, at = shingles(texts, n)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    return mix(h + nth.astype(np.uint64) * _P), at


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets without repeats; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0
