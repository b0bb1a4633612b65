"""Vectorised word and n-gram hashing over blocks of UTF-8 text.

A word is a run of bytes outside U+0020 and U+0009..U+000D, which is the same
set of words whether one looks at bytes or at code points.  Hashes are 64-bit:
a multilinear hash of the bytes, then a finaliser, combined linearly with odd
random factors for n-grams and finalised again.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words hashed at once.
PIECE = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def factors(n: int, seed: int = 0) -> np.ndarray:
    """``n`` odd 64-bit factors, the same in every process and for every n."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=_U) + _U(seed * 0x9E37)) * _U(0x9E3779B97F4A7C15)) | _U(1)


class Words:
    """The words of several texts: which text each is of, where it lies, its hash."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_at = np.concatenate(([0], np.cumsum(size)))[:-1]
        white = WHITE[data]
        edge = np.diff(white.astype(np.int8), prepend=1)
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n_texts = len(texts)
        self.doc = np.searchsorted(self.text_at, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n_texts)
        self.first = np.cumsum(self.count) - self.count
        size = self.end - self.start
        solid = data[~white]
        if lower:
            solid = LOWER[solid]
        if not len(size):
            self.hash = np.zeros(0, _U)
            return
        f = factors(int(size.max()) + 1)
        self.hash = np.empty(len(size), _U)
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):  # in pieces that stay in the cache
            base = int(ends[lo] - size[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            at = ends[lo:hi] - size[lo:hi] - base
            some = solid[base : int(ends[hi - 1])]
            place = np.arange(len(some)) - np.repeat(at, size[lo:hi])
            self.hash[lo:hi] = mixed(np.add.reduceat((some.astype(_U) + _U(1)) * f[place], at) + size[lo:hi].astype(_U))
            lo = hi

    def grams(self, n: int, seed: int = 1):
        """Hashes of all n-word runs within a text, and the word where each begins.

        A text of 1 to n-1 words gives its whole sequence as one run.
        """
        total, h = len(self.hash), self.hash
        f = factors(n + 1, seed)
        long = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :]) if total >= n else np.zeros(0, np.int64)
        acc = np.full(len(long), int(f[n]) * n & (2**64 - 1), _U)
        for j in range(n):
            acc += h[long + j] * f[j]
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if len(short):
            start, m = self.first[short], self.count[short]
            own = f[n] * m.astype(_U)
            for j in range(n - 1):
                use = m > j
                own[use] += h[start[use] + j] * f[j]
            long, acc = np.concatenate((long, start)), np.concatenate((acc, own))
            order = np.argsort(long, kind="stable")
            long, acc = long[order], acc[order]
        return mixed(acc), long

    def runs(self, n: int, seed: int = 2):
        """Like ``grams`` for long runs, texts with fewer words giving none: by prefix sums of a rolling polynomial."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        base = int(factors(1, seed)[0])
        inverse = pow(base, -1, 2**64)
        up, down = powers(base, total), powers(inverse, total)
        sums = np.zeros(total + 1, _U)
        np.cumsum(self.hash * up, out=sums[1:])
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return mixed((sums[at + n] - sums[at]) * down[at]), at


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(1, _U)
        step = base
        while len(have) < size:
            have = np.concatenate((have, have * _U(step)))
            step = step * step % 2**64
        _POWERS[base] = have
    return have[:n]
