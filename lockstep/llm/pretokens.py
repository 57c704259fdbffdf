"""Splitting texts by a tokenizer's pattern, and encoding the pieces through a bounded cache."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

#: Texts of code points below this are split with short character classes.
NARROW = 0x250
CLASSES = (r"\p{L}", r"\p{N}", r"\s")


@lru_cache(maxsize=None)
def _ranges(cls: str, end: int) -> str:
    """The code points below ``end`` that tiktoken's own pattern engine puts into ``cls``, as ranges for ``re``.

    Python's engines know another version of Unicode, so their classes may differ.
    """
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    engine = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks=ranks, special_tokens={})
    every = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    points = np.array(sorted(map(ord, set(bytes(engine.encode_ordinary(every)).decode()))))
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


@lru_cache(maxsize=None)
def compiled(pattern: str, end: int) -> re.Pattern:
    """``pattern`` for texts of code points below ``end``, with ``\\p{L} \\p{N} \\s \\S`` written out."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        cls = next((c for c in (*CLASSES, r"\S") if pattern.startswith(c, i)), "")
        if cls == r"\S" and inside:
            raise ValueError("\\S in brackets isn't supported")
        if cls == r"\S":
            out.append(f"[^{_ranges(CLASSES[2], end)}]")
        elif cls:
            out.append(_ranges(cls, end) if inside else f"[{_ranges(cls, end)}]")
        elif pattern[i] == "\\":
            cls = pattern[i : i + 2]
            out.append(cls)
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
        i += len(cls) or 1
    return re.compile("".join(out))


_WIDE = re.compile(f"[^\\x00-\\u{NARROW - 1:04x}]")


def split(pattern: str, text: str) -> list[str]:
    """The pieces that ``pattern`` matches in ``text``, as tiktoken finds them."""
    return compiled(pattern, 0x110000 if _WIDE.search(text) else NARROW).findall(text)


class CachedEncoder:
    """Encodes texts piece by piece, each distinct piece once while it is in the cache.

    ``encode_many`` gives the ids of a list of pieces; they are held as little-endian numbers of
    the ``array`` type ``kind``. The cache has two halves of up to ``limit / 2`` characters of pieces,
    about ten bytes of memory for each. A full half takes the place of the older one, and what is
    used from that again comes back, so memory stays bounded on any input.
    """

    def __init__(
        self, pattern: str, encode_many: Callable[[list[str]], Iterable[list[int]]], limit: int = 6_000_000, kind: str = "I"
    ):
        self.pattern, self.encode_many, self.limit, self.kind = pattern, encode_many, limit, kind
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` one after another; a null text has none."""
        pieces = split(self.pattern, text) if text else []
        found = list(map(self.known.get, pieces))
        if None not in found:
            return b"".join(found)
        holes = [i for i, ids in enumerate(found) if ids is None]
        new = {pieces[i]: self.older.get(pieces[i]) for i in holes}
        missing = [piece for piece, ids in new.items() if ids is None]
        if missing:
            for piece, ids in zip(missing, self.encode_many(missing)):
                new[piece] = array(self.kind, ids).tobytes()
        for i in holes:
            found[i] = new[pieces[i]]
        self.held += sum(map(len, new))
        if self.held > self.limit / 2:
            self.older, self.known, self.held = self.known, {}, sum(map(len, new))
        self.known.update(new)
        return b"".join(found)
