"""Suffix arrays over byte shards: Larsson-Sadakane refinement, Kasai common prefixes, binary search.

A shard is a list of strings in one buffer, each with ``starts[i]`` positions that matter: those from
which ``depth`` bytes lie within the string. Only these positions enter the array; it is ordered by
their first ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


class Shard:
    def __init__(self, strings: list[bytes], depth: int):
        self.depth = depth
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.starts = sizes - depth + 1
        data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.n = len(data)
        padded = np.concatenate([data, np.zeros(depth + 8, dtype=np.uint8)]).astype(np.uint64)
        #: eight bytes from each position as one number, in the order of the bytes
        self.words = np.zeros(self.n + depth, dtype=np.uint64)
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : k + len(self.words)]
        self.places = np.repeat(self.base - np.concatenate([[0], np.cumsum(self.starts)[:-1]]), self.starts) + np.arange(
            self.starts.sum()
        )
        self._refine()
        self._common()

    def _refine(self) -> None:
        """Ranks by 8, 16, 32, ... bytes; a round sorts only positions whose rank is still shared."""
        n, depth = self.n, self.depth
        order = np.argsort(self.words[:n])
        sorted_words = self.words[order]
        rank = np.empty(n + depth, dtype=np.int32)
        rank[n:] = -1
        fresh = np.append(True, sorted_words[1:] != sorted_words[:-1])  # entries that begin a rank, in their order
        shared, ranks = order, np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), n)))
        rank[shared] = ranks
        known = 8
        while known < depth:
            step = min(known, depth - known)
            alone = fresh & np.append(fresh[1:], True)
            shared, ranks = shared[~alone], ranks[~alone]
            if not len(shared):
                break
            # both ranks as one number: a shard has less than 2 ** 31 bytes
            pair = (ranks << 32) | (rank[shared + step] + 1)
            by = np.argsort(pair)
            shared, pair = shared[by], pair[by]
            fresh = np.append(True, pair[1:] != pair[:-1])
            index = np.arange(len(shared))
            group_at = np.maximum.accumulate(np.where(np.append(True, ranks[1:] != ranks[:-1]), index, 0))
            rank_at = np.maximum.accumulate(np.where(fresh, index, 0))
            ranks = ranks + rank_at - group_at  # sorted before, and pairs keep to their group
            rank[shared] = ranks
            known += step
        ranks = rank[self.places]
        by = np.argsort(ranks, kind="stable")
        #: array entries that share all ``depth`` bytes with the one before them
        self.same = np.append(False, ranks[by][1:] == ranks[by][:-1])
        self.array = self.places[by]
        #: where each position that matters stands in the array
        self.where = np.empty(len(by), dtype=np.int64)
        self.where[by] = np.arange(len(by))

    def _common(self) -> None:
        """Common prefix of each array entry with the one before it, ``depth`` at most.

        Going through a string from left to right, the entry before the last one moves along. Where its
        next position is in the array, and before the string's next one, the common prefix falls by
        one at most and the comparison goes on from there; else it begins anew. Entries of one rank share all
        bytes and are not compared. All strings take their steps together.
        """
        m, depth = len(self.places), self.depth
        self.common = np.zeros(m, dtype=np.int64)
        if m < 2:
            return
        offset = np.concatenate([[0], np.cumsum(self.starts)])[:-1]
        height = np.zeros(len(self.starts), dtype=np.int64)
        before = np.full(len(self.starts), -1, dtype=np.int64)  # the array's entry before the last position
        slot = np.full(self.n + 1, m, dtype=np.int64)
        slot[self.places] = self.where
        for t in range(int(self.starts.max())):
            active = np.flatnonzero(self.starts > t)
            at = self.where[offset[active] + t]
            has = at > 0
            before[active[~has]] = -1
            active, at = active[has], at[has]
            i, j = self.array[at], self.array[at - 1]
            last = before[active]
            follows = (last >= 0) & (slot[last + 1] < at)
            h = np.where(self.same[at], depth, np.where(follows, np.maximum(height[active] - 1, 0), 0))
            going = np.flatnonzero(h < depth)
            while len(going):
                differs = self.words[i[going] + h[going]] ^ self.words[j[going] + h[going]]
                same = np.full(len(going), 8, dtype=np.int64)
                odd = differs != 0
                bits = np.frexp((differs[odd] >> np.uint64(8)).astype(np.float64) + 0.0)[1]
                high = np.where(differs[odd] >> np.uint64(56), 64, bits + 8)
                exact = differs[odd]
                # frexp may round a number up to the next power of two
                high = np.where((high < 64) & ((exact >> np.minimum(high, 63).astype(np.uint64)) == 0)
                                & ((exact >> np.maximum(high - 1, 0).astype(np.uint64)) == 0), high - 1, high)
                same[odd] = (64 - high) // 8
                h[going] = np.minimum(h[going] + same, depth)
                going = going[(same == 8) & (h[going] < depth)]
            height[active], before[active] = h, j
            self.common[at] = h

    def repeated(self) -> np.ndarray:
        """For each position that matters, in the order of the strings: does another one share its bytes?"""
        full = self.common >= self.depth
        return (full | np.append(full[1:], False))[self.where]

    def _compare(self, other: Shard, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Sign of the order of ``depth`` bytes at pairs of positions."""
        out = np.zeros(len(mine), dtype=np.int8)
        left = np.arange(len(mine))
        for k in range(0, self.depth, 8):
            k = min(k, self.depth - 8)
            a, b = self.words[mine[left] + k], other.words[theirs[left] + k]
            out[left] = np.where(a < b, -1, np.where(a > b, 1, 0))
            left = left[a == b]
            if not len(left):
                break
        return out

    def found_in(self, other: Shard, which: np.ndarray) -> np.ndarray:
        """For some of the positions that matter: does the other shard hold the same bytes? By binary search."""
        mine = self.places[which]
        low, high = np.zeros(len(mine), dtype=np.int64), np.full(len(mine), len(other.array), dtype=np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            after = self._compare(other, mine[open_], other.array[middle]) > 0
            low[open_[after]] = middle[after] + 1
            high[open_[~after]] = middle[~after]
        inside = np.flatnonzero(low < len(other.array))
        out = np.zeros(len(mine), dtype=bool)
        out[inside] = self._compare(other, mine[inside], other.array[low[inside]]) == 0
        return out


def repeated_starts(strings: list[bytes], depth: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string, which of its starts share ``depth`` bytes with another start of any string.

    Strings beyond ``shard_bytes`` are dealt to several shards; what repeats within none of them is
    looked for in the other shards.
    """
    shards, part, size = [], [], 0
    for s in strings:
        if part and size + len(s) > shard_bytes:
            shards.append(Shard(part, depth))
            part, size = [], 0
        part.append(s)
        size += len(s)
    if part:
        shards.append(Shard(part, depth))
    flags = [s.repeated() for s in shards]
    for i, shard in enumerate(shards):
        for j, other in enumerate(shards):
            left = np.flatnonzero(~flags[i])
            if i != j and len(left):
                flags[i][left[shard.found_in(other, left)]] = True
    return [f for flag, s in zip(flags, shards) for f in np.split(flag, np.cumsum(s.starts)[:-1])]
