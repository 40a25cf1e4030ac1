"""Merges of token pairs, replayed over many words at once.

An inverted index holds, for every merge rank, the positions at which that pair stands.
The merges are taken in rank order; each one touches only the positions listed for it
and, of these, only the neighbours get new index entries.
"""

from __future__ import annotations

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)


class Pairs:
    """Which pairs of tokens merge, and at which rank. A token is named by the rank that makes it."""

    def __init__(self, left: list[int], right: list[int], ranks: list[int]):
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(ranks, np.int32)[order]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the pair does not merge."""
        if not len(self.keys):
            return np.full(len(a), NONE, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def replay(token: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the words that stand one after another in ``token``; none of them is empty.

    Returns the tokens that are left, how many of them each word has, and which words
    are to be encoded on their own, because a rank order over all words could differ
    from the order inside the word: a pair overlaps itself, or a merge makes a pair of
    lower rank.
    """
    token = token.copy()
    upto = np.cumsum(lengths)
    n = int(upto[-1])
    word_of = np.repeat(np.arange(len(lengths)), lengths)
    after = np.arange(1, n + 1, dtype=np.int64)
    after[upto - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int64)
    before[upto - lengths] = -1
    rank = np.full(n, NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = pairs.rank_of(token[inner], token[inner + 1])
    apart = np.zeros(len(lengths), bool)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        r = rank[positions]
        valid = r < NONE
        positions, r = positions[valid], r[valid]
        if not len(positions):
            return
        order = np.argsort(r, kind="stable")
        positions, r = positions[order], r[order]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for value, a, b in zip(r[starts].tolist(), starts, [*starts[1:], len(r)]):
            if value not in index:
                index[value] = []
                heapq.heappush(heap, value)
            index[value].append(positions[a:b])

    enter(inner)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        at = at[rank[at] == r]
        if not len(at):
            continue
        right = after[at]
        overlap = rank[right] == r
        if overlap.any():
            apart[word_of[at[overlap]]] = True
            keep = ~apart[word_of[at]]
            at, right = at[keep], right[keep]
            if not len(at):
                continue
        far = after[right]
        token[at] = r
        after[at] = far
        rank[right] = NONE
        rank[at] = NONE
        inside = far >= 0
        before[far[inside]] = at[inside]
        left = before[at]
        left = left[left >= 0]
        touched = np.concatenate([at[inside], left])
        if not len(touched):
            continue
        rank[touched] = pairs.rank_of(token[touched], token[after[touched]])
        lower = rank[touched] < r
        if lower.any():
            apart[word_of[touched[lower]]] = True
        enter(touched)

    # Symbols that were swallowed are those no chain from a word's start reaches.
    alive = np.zeros(n, bool)
    at = upto - lengths
    while len(at):
        alive[at] = True
        at = after[at]
        at = at[at >= 0]
    return token[alive], np.bincount(word_of[alive], minlength=len(lengths)), apart
