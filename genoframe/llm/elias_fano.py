"""Elias-Fano coded monotone sequences over arrays that may be mapped from files."""

from __future__ import annotations

import numpy as np

_ROWS = 1 << 15


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """low, high, ones and zeros (how many stand before each word of high) and meta (n, low bits) of a nondecreasing sequence."""
    values = values.astype(np.uint64)
    n = len(values)
    last = int(values[-1]) if n else 0
    bits = max(0, (last // n).bit_length() - 1) if n and last >= n else 0
    high_part = (values >> np.uint64(bits)).astype(np.int64)
    size = n + (int(high_part[-1]) if n else 0) + 1
    flags = np.zeros(-(-size // 64) * 64, np.uint8)
    flags[high_part + np.arange(n)] = 1
    high = np.packbits(flags, bitorder="little").view(np.uint64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
    zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
    kind = np.uint32 if len(high) < 2**26 else np.int64
    low = []
    if bits:
        places = np.arange(bits, dtype=np.uint64)
        for i in range(0, n, _ROWS):  # _ROWS values fill whole words
            part = ((values[i : i + _ROWS, None] >> places) & np.uint64(1)).astype(np.uint8).reshape(-1)
            raw = np.packbits(part, bitorder="little")
            low.append(np.concatenate([raw, np.zeros(-len(raw) % 8, np.uint8)]))
    low.append(np.zeros(16, np.uint8))
    return {"low": np.concatenate(low).view(np.uint64), "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind), "meta": np.array([n, bits], np.int64)}


class Monotone:
    """Access and successor search in an encoded sequence, for many positions or values at once."""

    def __init__(self, arrays: dict, prefix: str):
        self.low, self.high, self.ones, self.zeros = (arrays[f"{prefix}_{k}"] for k in ("low", "high", "ones", "zeros"))
        self.n, self.bits = map(int, arrays[f"{prefix}_meta"])
        self.buckets = len(self.high) * 64 - self.n

    def _inside(self, words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of each word, by halves."""
        place, r = np.zeros(len(words), np.int64), r.copy()
        for half in (32, 16, 8, 4, 2, 1):
            lower = words & np.uint64((1 << half) - 1)
            n = np.bitwise_count(lower)
            above = r >= n
            r -= np.where(above, n, 0)
            place += np.where(above, half, 0)
            words = np.where(above, words >> np.uint64(half), lower)
        return place

    def _select(self, ranks: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        w = np.searchsorted(ranks, k.astype(ranks.dtype), "right") - 1
        words = self.high[w]
        return w * 64 + self._inside(~words if flip else words, k - ranks[w])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        off = i.astype(np.uint64) * np.uint64(self.bits)
        w, s = (off >> np.uint64(6)).astype(np.int64), off & np.uint64(63)
        v = self.low[w] >> s
        v |= np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return v & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(self.ones, i, False) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x (n if there is none), and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        h = np.minimum(h, self.buckets - 1)
        beyond = (x >> np.uint64(self.bits)) >= np.uint64(self.buckets)
        # the ones between the zeros h - 1 and h are the values with this high part
        at = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), True) + 1, 0)
        lo = at - h
        w, off = np.minimum(at >> 6, len(self.high) - 1), (at & 63).astype(np.uint64)
        rest = ~(self.high[w] >> off)
        ones = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        stop = lo + ones
        over = np.flatnonzero(ones >= 64 - off.astype(np.int64))  # the run goes on in the next word
        if len(over):
            stop[over] = self._select(self.zeros, h[over], True) - h[over]
        stop = np.minimum(stop, self.n)
        lo = np.minimum(lo, stop)
        hi = stop.copy()
        want = x & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        lo = np.where(beyond, self.n, lo)
        equal = np.zeros(len(x), bool)
        at = np.flatnonzero((lo < stop) & ~beyond)
        equal[at] = self._low(lo[at]) == want[at]
        return lo, equal
