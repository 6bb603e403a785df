"""Word and shingle hashing over whole batches of texts.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text; everything else separates words.  Words
become 64-bit hashes with a handful of numpy passes over the batch's bytes,
so no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, dtype=np.int8)
_IS_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n, kept between calls."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _P), ("down", _P_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(28))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in page order and the index of its text; null is empty."""
    encoded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    if not encoded:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum(np.array([len(x) + 1 for x in encoded], dtype=np.int64))
    word = _IS_WORD[data]
    step = np.flatnonzero(np.diff(word, prepend=np.int8(0)))
    starts, ends = step[::2], step[1::2]
    up, down = _power_table(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(ends_of_text, starts, side="right")


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the text each belongs to.

    A text of 1 to size-1 words has one shingle made of all its words; a text
    without words has none.  Result is ordered by text; repeats are kept.
    """
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    k = np.uint64(0xD6E8FEB86659FD93)
    n = len(words) - size + 1
    if n > 0:
        h = words[:n].copy()
        for j in range(1, size):
            h = h * k + words[j : j + n]
        keep = owner[:n] == owner[size - 1 :]
        shingles, texts = mix(h[keep]), owner[:n][keep]
    else:
        shingles, texts = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            extra[has] = extra[has] * k + words[first[short[has]] + j]
        extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        shingles, texts = np.concatenate((shingles, extra)), np.concatenate((texts, short))
        order = np.argsort(texts, kind="stable")
        shingles, texts = shingles[order], texts[order]
    return shingles, texts


def chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of consecutive texts of about ``chars`` characters (or one longer text)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield slice(begin, i)
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield slice(begin, len(texts))
