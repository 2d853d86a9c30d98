"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes by Kasai's rule, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Up to this length a pair of ranks and a position share one 64-bit word, and a plain sort does for an argsort.
PACKED_BITS = 21


def _sorted_order(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Order of (high, low) pairs of ``bits`` bits each; equal pairs in input order."""
    n = len(high)
    if bits <= PACKED_BITS and n <= 1 << PACKED_BITS:
        word = (high.astype(np.uint64) << np.uint64(bits + PACKED_BITS)) | (low.astype(np.uint64) << np.uint64(PACKED_BITS)) | np.arange(n, dtype=np.uint64)
        word.sort()
        return (word & np.uint64((1 << PACKED_BITS) - 1)).astype(np.int64)
    return np.lexsort((low, high))


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of bytes. A suffix that ends sorts before those it begins."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # first order: as many symbols as fit beside a position
    symbol = np.zeros(256, np.uint64)
    present = np.flatnonzero(np.bincount(text, minlength=256))
    symbol[present] = np.arange(1, len(present) + 1)
    width = max(1, int(len(present)).bit_length())
    h = max(1, (2 * PACKED_BITS) // width)
    coded, key = symbol[text], np.zeros(n, np.uint64)
    for j in range(h):
        key <<= np.uint64(width)
        key[: max(0, n - j)] |= coded[j:]
    if n <= 1 << PACKED_BITS:
        word = (key << np.uint64(PACKED_BITS)) | np.arange(n, dtype=np.uint64)
        word.sort()
        order, ordered = (word & np.uint64((1 << PACKED_BITS) - 1)).astype(np.int64), word >> np.uint64(PACKED_BITS)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n, np.int64)
    rank[order] = first
    bits = max(1, int(n + 1).bit_length())
    while True:
        # only groups that are not yet single are refined, by the rank of what follows h symbols on
        last = np.concatenate([new[1:], [True]])
        places = np.flatnonzero(~(new & last))
        if not len(places):
            return order, rank
        at = order[places]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        own = rank[at]
        by = _sorted_order(own, after, bits)
        order[places] = at[by]
        own, after = own[by], after[by]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        new[places] = fresh
        start = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[order[places]] = start
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """For each place in ``order``: common prefix with the suffix before it, counted up to ``most``; 0 for the first.

    Kasai's rule: in text order a prefix is at most one shorter than that of the position before. Where the letters
    before both suffixes agree it is exactly one shorter, so only the other positions are compared, all at a time.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    position = np.arange(n)
    has = before >= 0
    follows = has & (position > 0) & (before > 0)
    follows[1:] &= text[position[1:] - 1] == text[np.maximum(before[1:], 1) - 1]
    start = np.flatnonzero(has & ~follows)
    other, length = before[start], np.zeros(len(start), np.int64)
    # runs are followed to their end even past ``most``, as the positions behind them count down from it: eight
    # letters at a time, then one by one
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(np.uint64).ravel()
    for step in (8, 1):
        live = np.arange(len(start))
        while len(live):
            a, b = start[live] + length[live], other[live] + length[live]
            inside = np.maximum(a, b) + step <= n
            live, a, b = live[inside], a[inside], b[inside]
            same = words[a] == words[b] if step == 8 else text[a] == text[b]
            live = live[same]
            length[live] += step
    reach = np.zeros(n, np.int64)
    reach[start] = start + length
    lengths = np.maximum(np.maximum.accumulate(reach) - position, 0)
    lengths[~has] = 0
    out = np.zeros(n, np.int64)
    out[rank] = np.minimum(lengths, most)
    return out


class Shard:
    """Distinct strings of ``length`` bytes that start at the valid positions of a text, sorted, with their least owner."""

    def __init__(self, text: np.ndarray, valid: np.ndarray, owner: np.ndarray, length: int):
        order, rank = suffix_array(text)
        shared = common_prefixes(text, order, rank, length)
        group = np.cumsum(shared < length) - 1
        use = valid[order]
        self.positions, of = order[use], group[use]
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        self.of = np.cumsum(first) - 1
        self.owner = np.minimum.reduceat(owner[self.positions], starts) if len(starts) else np.zeros(0, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else np.zeros((0, length), np.uint8)
        self.strings = np.ascontiguousarray(view[self.positions[starts]]).view(f"S{length}").ravel()

    def merge(self, other: Shard) -> None:
        """Strings that both shards have get the lesser owner, in both; found by binary search."""
        if not len(self.strings) or not len(other.strings):
            return
        at = np.searchsorted(other.strings, self.strings)
        at[at == len(other.strings)] = 0
        mine = np.flatnonzero(other.strings[at] == self.strings)
        theirs = at[mine]
        least = np.minimum(self.owner[mine], other.owner[theirs])
        self.owner[mine] = least
        other.owner[theirs] = least

    def owners(self, n: int) -> np.ndarray:
        """Least owner of the string at each valid position; the others hold the greatest integer."""
        out = np.full(n, np.iinfo(np.int64).max)
        out[self.positions] = self.owner[self.of]
        return out
