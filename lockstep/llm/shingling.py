"""Sets of word n-grams as sorted 64-bit hashes, found in numpy over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_RANDOM = np.random.default_rng(20240611)


def _odd(n: int) -> np.ndarray:
    return _RANDOM.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes hashed at once; a longer text is hashed in such steps.
BLOCK = 1 << 19
#: Longer words are hashed one by one.
LONG = 4096
_BYTE, _PLACE, _BASE = _odd(256), _odd(16), int(_odd(1)[0])
#: A-Z count as a-z.
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS = _powers(_BASE, BLOCK + LONG)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), BLOCK + LONG)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and their number) of texts laid end to end.

    Words are runs of bytes other than ASCII white space; text k lies from ``bounds[k]`` to
    ``bounds[k + 1]``.
    """
    low, high = int(bounds[0]), int(bounds[-1])
    inside = np.zeros(high - low + 2, bool)
    np.logical_not(_SPACE[data[low:high]], out=inside[1:-1])
    border = np.zeros(high - low + 1, bool)
    border[bounds - low] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border)) + low
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border)) + low
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(starts, base + BLOCK))
        sums = np.zeros(min(BLOCK + LONG, high - base) + 1, np.uint64)
        span = data[base : base + len(sums) - 1]
        np.cumsum(_BYTE[span] * _POWERS[: len(span)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        size = e - s
        h = (sums[np.minimum(e, len(span))] - sums[s]) * _INVERSE[s]
        out[at:to] = _mixed(h + size.astype(np.uint64) * _PLACE[-1])
        for i in np.flatnonzero(size > LONG):
            raw = data[base + s[i] : base + e[i]].tobytes().translate(_LOWER)
            out[at + i] = xxhash.xxh3_64_intdigest(raw)
        at = to
    return out, np.searchsorted(starts, bounds)


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``n`` words, ascending: of all its words where it has fewer, none without words."""
    words, firsts = word_hashes(data, bounds)
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for j in range(n):
        grams += words[j : j + len(grams)] * _PLACE[j]
    grams = _mixed(grams)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= n:
            found = grams[a : b - n + 1].copy()
            found.sort()
            yield found[np.append(True, found[1:] != found[:-1])]
        elif b > a:
            yield _mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield words[:0]


def reordered(tokens: np.ndarray, salt: int) -> np.ndarray:
    """The tokens in another global order, by a salted hash of them."""
    return tokens[np.argsort(_mixed(tokens ^ _PLACE[salt]), kind="stable")]


def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes; a longer text is alone."""
    k = 0
    while k + 1 < len(bounds):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK, "right")) - 1)
        yield k, last
        k = last
