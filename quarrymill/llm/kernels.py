"""Vectorised text kernels: words, rolling hashes and windows grouped by their smallest gram.

A window is a run of ``width`` units (bytes or words) of one document. Every window gets an anchor: the
smallest hash among its grams of ``gram`` units. Equal windows have equal anchors, so all copies of a window
meet wherever rows are dealt by anchor. Consecutive windows of equal anchor form one segment.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_Q = U(0xC2B2AE3D27D4EB4F)
_S33, _S29, _S32 = U(33), U(29), U(32)
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: Units handled at once (their arrays stay in a core's cache); longer documents are cut into overlapping pieces.
PIECE = 1 << 18
#: The whitespace of the contracts: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@functools.lru_cache(4)
def powers(n: int) -> np.ndarray:
    """p**0 to p**(n-1), modulo 2**64."""
    out = np.full(n, _P, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (in place)."""
    h ^= h >> _S33
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = PIECE):
    """Row ranges (first, end) of at most ``most`` units each, single rows where a row is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end
        first = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word ``[^\\x20\\x09-\\x0D]+``, and the n + 1 word offsets of the rows."""
    solid = np.empty(len(raw) + 1, bool)
    np.logical_not(SPACE[raw], out=solid[:-1])
    solid[-1] = False
    starts = solid.copy()
    starts[1:-1] &= ~solid[:-2]
    row_first = offsets[:-1][offsets[:-1] < len(raw)]
    starts[row_first] = solid[row_first]
    ends = solid[:-1] & ~solid[1:]
    row_last = offsets[1:][offsets[1:] > 0] - 1
    ends[row_last] = solid[row_last]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(s), U)
    # by blocks of bytes, so that the prefix sums stay small
    first = 0
    while first < len(s):
        end = max(first + 1, int(np.searchsorted(e, s[first] + PIECE, "right")))
        lo, hi = int(s[first]), int(e[end - 1])
        pw = powers(max(PIECE, 1 << (hi - lo).bit_length()) + 1)
        sums = np.zeros(hi - lo + 1, U)
        np.cumsum((raw[lo:hi].astype(U) + U(1)) * pw[: hi - lo], out=sums[1:])
        a, b = s[first:end] - lo, e[first:end] - lo
        h = (sums[b] - sums[a]) * pw[(hi - lo) - a]
        # scaled to a power that no longer depends on the place
        out[first:end] = h * inverse_power(hi - lo)
        first = end
    return mix(out)


@functools.lru_cache(1 << 14)
def inverse_power(n: int) -> np.uint64:
    """p**-n modulo 2**64."""
    return U(pow(pow(int(_P), n, 1 << 64), -1, 1 << 64))


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for sizes[0] places, and so on."""
    total = int(sizes.sum())
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (k small), as uint64."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = values[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += values[j : j + n]
    return mix(out)


def byte_gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive bytes."""
    n = len(raw) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    pw = powers(max(PIECE, 1 << len(raw).bit_length()) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * pw[: len(raw)], out=sums[1:])
    out = sums[k:] - sums[:-k]
    out *= pw[len(raw) - n + 1 : len(raw) + 1][::-1]
    out *= inverse_power(len(raw))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def segments(grams: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window (positions in units) and anchor of every segment.

    ``grams``: hash of the gram that starts at each unit; ``offsets``: unit offsets of the rows.
    """
    return stretches(sliding_min(grams, width - gram + 1), offsets, width)


def stretches(lows: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of one value in ``lows`` (a window's value stands at its first unit), none across rows."""
    n = len(lows)
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    lengths = np.diff(offsets)
    long_rows = np.flatnonzero(lengths >= width)
    edge = np.zeros(n + 1, np.int32)
    edge[offsets[long_rows]] += 1
    stops = offsets[long_rows + 1] - width + 1
    np.add.at(edge, stops, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(lows[1:], lows[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    row_first = offsets[long_rows]
    new[row_first] = True
    first = np.flatnonzero(new & valid)
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    row = np.searchsorted(offsets, first, "right") - 1
    last = np.minimum(np.append(first[1:], n) - 1, offsets[row + 1] - width)
    return row, first, last, lows[first]


def loops(grams: np.ndarray, first: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Flags the segments in which the anchor's gram occurs twice, so that a window may repeat inside one.

    A gram is an anchor's if it equals the largest minimum of the windows that cover it. Two neighbouring
    occurrences mark the segments of all windows that hold both.
    """
    count = width - gram + 1
    lows = sliding_min(grams, count)
    wall = np.zeros(count - 1, U)
    covers = ~sliding_min(~np.concatenate([wall, lows, wall]), count)
    at = np.flatnonzero(grams == covers)
    value = grams[at]
    k = np.flatnonzero((value[1:] == value[:-1]) & (at[1:] - at[:-1] < count))
    edge = np.zeros(len(first) + 1, np.int64)
    np.add.at(edge, np.maximum(np.searchsorted(first, at[k + 1] - count + 1, "right") - 1, 0), 1)
    np.add.at(edge, np.searchsorted(first, at[k], "right"), -1)
    return np.cumsum(edge[:-1]) > 0
