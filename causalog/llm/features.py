"""Vectorised text features over the bytes of many documents at once (numpy)."""

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> _SHIFT)
    h = h * _MIX
    h = h ^ (h >> _SHIFT)
    h = h * _MIX
    return h ^ (h >> _SHIFT)


class SpanHash:
    """Hashes of any spans of a byte or code point buffer in constant time each.

    A polynomial in an odd base modulo 2^64: the difference of two prefix sums, brought
    back to position 0 by the inverse power, then mixed.
    """

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])
        self.back = down

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + np.uint64(salt))

    def without(self, start: int, end: int, at: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of one span with a single element left out, for each place in ``at``."""
        kept = (self.sums[at] - self.sums[start]) + (self.sums[end] - self.sums[at + 1]) * np.uint64(_INVERSE)
        return mix(kept * self.back[start] + np.uint64(salt))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of True; a run ends with its document."""
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the documents' offsets among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    points = first.astype(np.uint32)
    if len(at) != len(data):
        padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
        for least, most, bits in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF7, 3)):
            own = np.flatnonzero((first >= least) & (first <= most))
            value = points[own] & (0x3F >> bits)
            for j in range(1, bits + 1):
                value = (value << 6) | (padded[at[own] + j] & 0x3F)
            points[own] = value
    before = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    return points, before[offsets]


_TABLE = 0x2000  # code points below are folded by table, the rest one by one


def letters(points: np.ndarray) -> np.ndarray:
    """Code points with letters in lower case and 0 for everything that is not a letter."""
    table = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(_TABLE)], np.uint32)
    out = table[np.minimum(points, _TABLE - 1)]
    for c in np.unique(points[points >= _TABLE]).tolist():
        out[points == c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
    return out


def gram_buckets(chars: np.ndarray, bits: int, orders: int = 3) -> list[np.ndarray]:
    """Hash buckets of the 1- to ``orders``-grams starting at every character."""
    out = []
    h = np.zeros(len(chars), np.uint32)
    for order in range(orders):
        h = h[: len(chars) - order] if order else h
        h = (h ^ chars[order:]) * np.uint32(0x85EBCA6B) + np.uint32(order + 1)
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))
    return out


def squeeze(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of non-letters (zeros) as one, so that n-grams see word borders alike."""
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 0) | (chars[:-1] != 0)
    before = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    return chars[keep], before[offsets]
