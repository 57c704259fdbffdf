"""Suffix arrays of a shard of byte strings: Larsson-Sadakane refinement, Kasai's common prefixes, binary search."""

from __future__ import annotations

import numpy as np

#: Bytes in the first sort key; its last byte says how many of them the string still had.
FIRST = 7


class Shard:
    """Byte strings laid end to end; suffixes end with their own string."""

    def __init__(self, strings: list[bytes], depth: int):
        """``depth``: prefixes are compared up to this many bytes."""
        self.depth = depth
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.ends = np.repeat(self.starts + self.sizes, self.sizes)

    def suffix_array(self) -> np.ndarray:
        """Positions in the order of their suffixes; equal ones in the order of their strings.

        Ranks by the first bytes are refined by doubling: each round sorts the groups that
        are still tied by the rank of what follows, and leaves the others alone. The order is
        a total one, as Kasai's rule needs: as if each string ended with a mark of its own.
        """
        n = len(self.text)
        rest = self.ends - np.arange(n)
        key = np.minimum(rest, FIRST).astype(np.uint64)
        for j in range(FIRST):
            byte = np.zeros(n, np.uint64)
            byte[: n - j] = self.text[j:]
            key |= np.where(rest > j, byte, 0).astype(np.uint64) << np.uint64(8 * (FIRST - j))
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        heads, tied = _groups(key[order])
        rank[order] = heads
        seen, longest = FIRST, int(self.sizes.max(initial=0))
        at = np.flatnonzero(tied)
        while seen < longest and len(at):
            position = order[at]
            after = position + seen
            inside = after < self.ends[position]
            follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            both = rank[position].astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64)
            inner = np.argsort(both, kind="stable")
            position, both = position[inner], both[inner]
            order[at] = position
            heads, tied = _groups(both)
            rank[position] = at[heads]
            at = at[tied]
            seen *= 2
        self.order, self.rank = order, rank
        return order

    def common_prefixes(self) -> np.ndarray:
        """For each position the common prefix with the suffix before it in the array, up to ``depth``.

        Kasai's rule, one string a lane and all lanes in step: from one position to the
        next a common prefix shrinks by one at most, so each lane goes on from there.
        """
        n = len(self.text)
        before = np.full(n, -1, np.int64)
        before[self.order[1:]] = self.order[:-1]
        out = np.zeros(n, np.int64)
        length = np.zeros(len(self.sizes), np.int64)
        by_size = np.argsort(-self.sizes, kind="stable")
        live = len(by_size)
        for t in range(int(self.sizes.max(initial=0))):
            while live and self.sizes[by_size[live - 1]] <= t:
                live -= 1
            lanes = by_size[:live]
            here = self.starts[lanes] + t
            there = before[here]
            now = np.maximum(length[lanes] - 1, 0)
            now[there < 0] = 0
            most = np.minimum(self.ends[here] - here, self.ends[np.maximum(there, 0)] - there)
            most = np.where(there < 0, 0, np.minimum(most, self.depth))
            grow = np.flatnonzero(now < most)
            while len(grow):
                same = self.text[here[grow] + now[grow]] == self.text[there[grow] + now[grow]]
                grow = grow[same]
                now[grow] += 1
                grow = grow[now[grow] < most[grow]]
            length[lanes] = now
            out[here] = now
        self.common = out
        return out

    def repeated(self) -> np.ndarray:
        """Whether the ``depth`` bytes from each position also start elsewhere in the shard."""
        near = self.common[self.order] >= self.depth
        out = np.zeros(len(self.text), bool)
        out[self.order] = near | np.append(near[1:], False)
        return out

    def find(self, other: Shard, positions: np.ndarray, lot: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Which ``depth`` bytes of ``other`` at ``positions`` occur here, and a mask of the positions here where one does.

        A binary search of the suffix array for each, all in step.
        """
        n, depth = len(self.order), self.depth
        found = np.zeros(len(positions), bool)
        hit = np.zeros(n + 1, bool)
        span = np.arange(depth)
        for at in range(0, len(positions), lot):
            wanted = other.text[positions[at : at + lot, None] + span]
            low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n, np.int64)
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                less = self._compare(middle, wanted[open_]) < 0
                low[open_[less]] = middle[less] + 1
                high[open_[~less]] = middle[~less]
            there = np.flatnonzero(low < n)
            there = there[self._compare(low[there], wanted[there]) == 0]
            found[at + there] = True
            hit[low[there]] = True
        # the first suffix of each group of equal ones was hit; carry it through the group
        group = np.cumsum(np.append(True, self.common[self.order][1:] < depth)) - 1
        groups = np.zeros(n + 1, bool)
        groups[group[np.flatnonzero(hit[:n])]] = True
        here = np.zeros(n, bool)
        here[self.order] = groups[group]
        return found, here

    def _compare(self, entries: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Sign of the suffixes at ``entries`` of the array against the rows of ``wanted``; a proper prefix is less."""
        position = self.order[entries]
        where = position[:, None] + np.arange(self.depth)
        inside = where < self.ends[position][:, None]
        mine = np.where(inside, self.text[np.minimum(where, len(self.text) - 1)].astype(np.int16), -1)
        differ = mine != wanted
        first = differ.argmax(axis=1)
        rows = np.arange(len(entries))
        return np.sign(mine[rows, first] - wanted[rows, first].astype(np.int16)) * differ[rows, first]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the index of each one's first equal, and whether it has an equal at all."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = np.append(True, keys[1:] != keys[:-1])
    heads = np.flatnonzero(new)[np.cumsum(new) - 1]
    return heads, ~(new & np.append(new[1:], True))
