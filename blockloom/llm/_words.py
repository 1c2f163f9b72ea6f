"""Words of whole text columns as 64-bit codes, found by array operations on UTF-8 bytes.

A code is a keyed polynomial, modulo 2**64, over the lower-cased bytes of a word.
Equal words have equal codes; different words of texts that weren't made to collide
differ but for a chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

SHINGLE, ALNUM = "shingle", "alnum"  #: the two kinds of word


def _is_word(kind: str) -> np.ndarray:
    table = np.ones(256, bool)
    if kind == SHINGLE:  # everything but blank, tab, line and page breaks
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:  # digits, letters and everything beyond ASCII
        table[:0x80] = False
        table[ord("0") : ord("9") + 1] = table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = True
    return table


class WordCodes:
    def __init__(self, kind: str):
        self.word = _is_word(kind)
        rng = np.random.Generator(np.random.PCG64(20))
        self.weight = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weight[ord("A") : ord("Z") + 1] = self.weight[ord("a") : ord("z") + 1]
        self.p = 0x9E3779B97F4A7C15
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 19)
            self.powers = np.full(n, self.p, np.uint64)
            self.inverse = np.full(n, pow(self.p, -1, 1 << 64), np.uint64)
            for table in (self.powers, self.inverse):
                table[0] = 1
                np.cumprod(table, out=table)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words and the first word's index of each text, with the end added.

        ``bounds``: the texts' starts in ``data`` and its end.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        inside = self.word[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self._grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.weight[data] * self.powers[:n], out=total[1:])
        codes = (total[ends] - total[starts]) * self.inverse[starts]
        return mix(codes), np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit codes over all others; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of ``size`` words, by its first word; order matters."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        total += codes[k : k + n] * np.uint64(factor)
    return mix(total)
