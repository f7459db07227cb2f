"""Suffix order, Burrows-Wheeler transform and wavelet matrix over integer symbols, all in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int, steps: list[tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Starts of all suffixes, in order of their first ``depth`` symbols at least (0 sorts lowest).

    Prefix doubling (tripling, where three ranks fit 63 bits) that starts from as many symbols as fit 63 bits and
    then touches only suffixes that are still tied. ``steps`` takes the numbers of symbols sorted by on the way, below ``depth``, each with a flag
    where a suffix differs in them from the one before.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    have = max(1, min(63 // bits, depth))
    padded = np.zeros(n + have, np.uint64)
    padded[:n] = symbols
    key = padded[:n].copy()
    for j in range(1, have):
        key <<= np.uint64(bits)
        key |= padded[j : j + n]
    order = np.argsort(key)  # which of equal suffixes comes first does not matter
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key
    slots = np.arange(n)
    head = np.maximum.accumulate(np.where(fresh, slots, 0))
    rank = np.empty(n + 1, np.int64)  # one more than the first place of equal suffixes
    rank[order] = head + 1
    rank[n] = 0
    parted = fresh
    while have < depth:
        if steps is not None:
            steps.append((have, fresh.copy()))
        still = ~parted
        still[:-1] |= ~parted[1:]
        slots, head = slots[still], head[still]
        if not len(slots):
            break
        at = order[slots]
        both = head
        times = 3 if 3 * have < depth and (n + 1) ** 3 < 1 << 63 else 2
        for k in range(1, times):
            both = both * (n + 1) + rank[np.minimum(at + k * have, n)]
        by = np.argsort(both)
        at, both = at[by], both[by]
        order[slots] = at
        parted = np.ones(len(slots), bool)
        parted[1:] = both[1:] != both[:-1]
        fresh[slots] = parted
        head = slots[np.maximum.accumulate(np.where(parted, np.arange(len(slots)), 0))]
        rank[at] = head + 1
        have *= times
    return order


class Wavelet:
    """Wavelet matrix: one packed bit vector with block counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = n = len(symbols)
        self.bits = max(1, int(top).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        current = np.asarray(symbols, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = ((current >> np.uint32(level)) & np.uint32(1)).astype(bool)
            words = np.zeros((n >> 6) + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=counts[1:])
            zeros = n - int(bit.sum())
            self.levels.append((words, counts.astype(np.int32), zeros))
            current = np.concatenate([current[~bit], current[bit]])
        #: where each symbol's run starts once all levels are passed, and the count of smaller symbols
        per = np.bincount(symbols, minlength=top + 1)
        self.smaller = np.concatenate([[0], np.cumsum(per)])
        self.bottom = np.zeros(top + 2, np.int64)
        reverse = np.zeros(top + 1, np.int64)
        for b in range(self.bits):
            reverse |= ((np.arange(top + 1) >> b) & 1) << (self.bits - 1 - b)
        by = np.argsort(reverse, kind="stable")
        self.bottom[by] = np.concatenate([[0], np.cumsum(per[by])[:-1]])

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & low)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol + pattern from the intervals [lo, hi) of the patterns."""
        n = len(lo)
        at = np.concatenate([lo, hi])
        twice = np.concatenate([symbol, symbol])
        for k, (words, counts, zeros) in enumerate(self.levels):
            ones = self._ones(words, counts, at)
            bit = (twice >> (self.bits - 1 - k)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        at = at - self.bottom[twice] + self.smaller[twice]
        return at[:n], at[n:]

    def extensions(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and interval of every non-empty backward extension of the intervals [lo, hi)."""
        symbol = np.zeros(len(lo), np.int32)
        for words, counts, zeros in self.levels:
            both = self._ones(words, counts, np.concatenate([lo, hi]))
            a, b = both[: len(lo)], both[len(lo) :]
            left, right = (hi - lo) > (b - a), b > a
            symbol <<= 1
            symbol = np.concatenate([symbol[left], symbol[right] | 1])
            lo, hi = np.concatenate([(lo - a)[left], a[right] + np.int32(zeros)]), np.concatenate([(hi - b)[left], b[right] + np.int32(zeros)])
        shift = (self.smaller[symbol] - self.bottom[symbol]).astype(lo.dtype)
        return symbol, lo + shift, hi + shift


def concatenate(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All parts, each followed by a 0, and the place of each part's first symbol (and the end)."""
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)
    out = np.zeros(starts[-1], parts[0].dtype if parts else np.int64)
    for p, s in zip(parts, starts[:-1]):
        out[s : s + len(p)] = p
    return out, starts


def transform(symbols: np.ndarray, depth: int, top: int, steps: list[tuple[int, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, Wavelet]:
    """Suffix order, the symbols with an end mark, and the wavelet matrix of their Burrows-Wheeler transform.

    All symbols are raised by one and 0 marks the end, so that the rows of the transform map onto each other.
    """
    marked = np.zeros(len(symbols) + 1, np.uint16 if top < 65_000 else np.int64)
    np.add(symbols, 1, out=marked[:-1], casting="unsafe")
    order = suffix_order(marked, depth, steps)
    return order, marked, Wavelet(marked[order - 1], top + 1)


def fewest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


class FmIndex:
    """Compressed index over parts that a 0 ends each: the wavelet matrix of their Burrows-Wheeler transform, and the
    number of the part that each row begins in, in the fewest bytes. The suffix order is not kept."""

    def __init__(self, symbols: np.ndarray, part: np.ndarray, depth: int, top: int):
        order, _, self.wavelet = transform(symbols, depth, top)
        self.part = fewest(part[order[1:]])  # the first row is the end mark's

    def statistics(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream at some of its places, up to ``most``.

        For each place: how many symbols that end there occur at two places of the index or more, found by backward
        search; a search whose interval shrinks to one row stops. And the intervals of those that reach ``most``,
        as rows of ``part``.
        """
        reach = np.zeros(len(ends), np.uint8)
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.part) + 1, np.int64)
        for back in range(most):
            lo, hi = self.wavelet.extend(stream[ends[alive] - back].astype(np.int64) + 1, lo, hi)
            more = hi - lo > 1
            alive, lo, hi = alive[more], lo[more], hi[more]
            reach[alive] += 1
        return reach, lo - 1, hi - 1

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest part among the rows of each interval."""
        if not len(lo):
            return lo
        first, back = np.unique(lo, return_inverse=True)
        end = np.zeros(len(first), np.int64)
        end[back] = hi
        padded = np.append(self.part, self.part[-1:])
        return np.minimum.reduceat(padded, np.stack([first, end], 1).ravel())[::2][back].astype(np.int64)


def common_prefix_groups(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and a flag where a suffix shares fewer than ``depth`` symbols with the one before.

    Breadth-first backward extension on the transform: the intervals of all strings of length l are
    extended by each symbol that precedes them; an interval that ends at a place whose common prefix is
    not known yet gives it the value l and is extended further, others are dropped. Values are found in
    increasing order, and the search stops at ``depth``; what is unknown then is at least ``depth``.
    The search begins with the longest strings below ``depth`` whose intervals the sort has had on its way. Of these
    go on only those whose end the step before has left unknown: an extension's end shares at most one symbol more
    than the end of what is extended, so those of the others are known.
    The row of the end mark is left out.
    """
    n = len(symbols)
    top = int(symbols.max()) if n else 0
    steps: list[tuple[int, np.ndarray]] = []
    order, _, wavelet = transform(symbols, depth, top, steps)
    known = np.zeros(n + 2, bool)
    known[0] = known[n + 1] = True
    lo, hi, length = np.zeros(1, np.int32), np.full(1, n + 1, np.int32), 0
    if steps:
        length, known[: n + 1] = steps[-1]
        ends = np.flatnonzero(known).astype(np.int32)
        lo, hi = ends[:-1], ends[1:]
        if len(steps) > 1:
            deep = ~np.append(steps[-2][1], True)[hi]
            lo, hi = lo[deep], hi[deep]
        steps.clear()
    while length < depth and len(lo):
        _, lo, hi = wavelet.extensions(lo, hi)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
        length += 1
    return order[1:], known[1 : n + 1]
