"""Rolling hashes over bytes and words, vectorised (numpy).

A window's hash is a polynomial over 64-bit values modulo 2^64, taken from
prefix sums, so that hashing every window of a text costs a few array passes
whatever the window's length.  Results go through a finaliser that spreads
them over all bits.  Two ``Poly`` with different bases are independent.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_G = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Poly:
    """Polynomial hash with an odd base; powers are kept and grow on demand."""

    def __init__(self, seed: int) -> None:
        s = mix(np.arange(1, 259, dtype=U) * U(_G) + U(seed))
        self.table = s[:256]
        self.base = int(s[256]) | 1
        self._pw = self._ipw = np.ones(1, U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pw) < n:
            for name, b in (("_pw", self.base), ("_ipw", pow(self.base, -1, 1 << 64))):
                a = np.full(max(n, 1 << 16, 2 * len(getattr(self, name))), b, U)
                a[0] = 1
                setattr(self, name, np.cumprod(a))
        return self._pw[:n], self._ipw[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        pw, _ = self._powers(len(values))
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * pw, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]``, its length included."""
        _, ipw = self._powers(len(prefix))
        return mix((prefix[end] - prefix[start]) * ipw[start] + (end - start).astype(U) * U(_G))

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of every ``k`` consecutive values."""
        n = len(prefix) - k  # windows, as the prefix has one entry more than the values
        if n <= 0:
            return np.zeros(0, U)
        _, ipw = self._powers(len(prefix))
        return mix((prefix[k:] - prefix[:n]) * ipw[:n])


FIRST, SECOND = Poly(11), Poly(77)


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost least of each ``w`` consecutive keys (keys compared by their upper bits)."""
    n = len(keys)
    bits = max(1, int(n - 1).bit_length())
    low = U((1 << bits) - 1)
    a = (keys & ~low) | np.arange(n, dtype=U)
    width = 1
    while 2 * width <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    if width < w:
        a = np.minimum(a[: len(a) - (w - width)], a[w - width:])
    return (a & low).astype(np.int64)


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_PIECE = 1 << 20


def words(data: bytes, separators: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word (between ASCII white space by default), in pieces of bounded size."""
    arr = np.frombuffer(data, np.uint8)
    space = separators[arr]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(arr) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(arr) and not space[-1]:
        edge = np.concatenate((edge, [len(arr)]))
    start, end = edge[::2], edge[1::2]
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        at = int(start[i])
        p = FIRST.prefix(FIRST.table[arr[at:int(end[j - 1])]])
        out[i:j] = FIRST.spans(p, start[i:j] - at, end[i:j] - at)
        i = j
    return out, start, end


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)])) - 1


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the half-open spans."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    s, e = start[o], np.maximum.accumulate(end[o])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    at = np.flatnonzero(first)
    return s[at], np.concatenate((e[at[1:] - 1], e[-1:]))
