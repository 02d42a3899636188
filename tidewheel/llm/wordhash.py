"""64-bit hashes of all words of many texts at once, and sets of shingles."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
_LETTER = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept, and doubled when too short."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, np.uint64)
        while len(got) < n:
            got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values; ``np.unique`` hashes them first, which takes several times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the white-space-separated words of all texts in order, each word's text and bytes."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, len(data))[start])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]) if texts else np.zeros(0, np.int64)
    return hashes, np.searchsorted(first, start, "right") - 1, end - start


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle."""
    words, of, _ = word_hashes(texts)
    counts = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(counts)
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += words[j : j + n] * _PLACE[j]
    rolled = mix(rolled)
    out = []
    for count, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= k:
            out.append(distinct(rolled[end - count : end - k + 1]))
        elif count:
            own = words[end - count : end]
            out.append(mix((own * _PLACE[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
