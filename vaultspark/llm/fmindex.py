"""A compressed full-text index of a shard: Burrows-Wheeler transform under a wavelet tree, and matching statistics by backward
search. All steps run for many texts at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask).astype(np.int64)


class WaveletTree:
    """Counts of a symbol in prefixes of a sequence, one bit vector per binary digit, zeros before ones on every level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for d in reversed(range(self.depth)):
            bits = (sequence >> d) & 1
            self.levels.append(BitVector(bits))
            self.zeros.append(len(bits) - int(bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.start = np.searchsorted(self._order(sequence), self._reverse(np.arange(symbols)))

    def _reverse(self, symbols: np.ndarray) -> np.ndarray:
        """The last level is sorted by the digits read from the lowest."""
        out = np.zeros_like(symbols)
        for d in range(self.depth):
            out |= ((symbols >> d) & 1) << (self.depth - 1 - d)
        return out

    def _order(self, last: np.ndarray) -> np.ndarray:
        return self._reverse(last)

    def counts(self, symbol: np.ndarray, *ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end, a row for each of ends."""
        at = np.stack(ends)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.depth - 1 - level)) & 1 == 1
            ranks = bits.rank(at)
            at = np.where(one, zeros + ranks, at - ranks)
        return at - self.start[symbol]


class FMIndex:
    """texts: arrays of symbols from 1; weights: how often each text counts."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, symbols: int):
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        data = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        data[inside] = np.concatenate(texts)
        first = data + len(texts)
        first[ends] = np.arange(len(texts))  # every end is smaller than all symbols and unlike the others
        ranks, step = [np.unique(first, return_inverse=True)[1]], 1
        while step <= lengths.max():  # prefix doubling
            now = ranks[-1]
            second = np.zeros(n, np.int64)
            second[:-step] = now[step:] + 1
            ranks.append(np.unique(now * np.int64(n + 1) + second, return_inverse=True)[1])
            step *= 2
        suffix = np.empty(n, np.int64)
        suffix[ranks[-1]] = np.arange(n)
        self.size = n
        self.tree = WaveletTree(data[suffix - 1], symbols + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=symbols + 1))])
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, lengths + 1)[suffix])])
        # longest common prefix of neighbours in suffix order, from the ranks that doubling went through
        a, b = suffix[:-1].copy(), suffix[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for k in reversed(range(len(ranks))):
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
            jump = np.where(same, 1 << k, 0)
            a, b, common = a + jump, b + jump, common + jump
        lcp = np.concatenate([[-1], common, [-1]]).astype(np.int32)  # lcp[i]: suffixes i-1 and i
        self.low = [lcp]  # minima over 2^k neighbours, as far as suffixes with one symbol in common reach
        while (1 << len(self.low)) <= min(len(lcp), np.bincount(data).max()):
            half, last = 1 << (len(self.low) - 1), self.low[-1]
            self.low.append(np.minimum(last[:-half], last[half:]))

    def _widen(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that share `depth` symbols with those of [lo, hi); of no symbols, all."""
        whole = depth == 0
        depth = np.where(whole, len(self.low[0]), depth)
        for k in reversed(range(len(self.low))):
            low = self.low[k]
            at = lo - (1 << k) + 1
            ok = at >= 0
            ok[ok] = low[at[ok]] >= depth[ok]
            lo = np.where(ok, lo - (1 << k), lo)
        for k in reversed(range(len(self.low))):
            low = self.low[k]
            ok = hi < len(low)
            ok[ok] = low[hi[ok]] >= depth[ok]
            hi = np.where(ok, hi + (1 << k), hi)
        return np.where(whole, 0, lo), np.where(whole, self.size, hi)

    def matching_statistics(self, texts: list[np.ndarray], least: int) -> np.ndarray:
        """For each place of each text, one text after the other, the longest match that starts there and has weight `least` or more in the index. Texts
        are read from their ends; a match that can't be extended to the left is shortened at its right by going to the parent
        interval."""
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        data, out = np.concatenate(texts), np.zeros(int(starts[-1]), np.int32)
        place = lengths - 1  # next symbol to the left
        lo, hi, size = np.zeros(len(texts), np.int64), np.full(len(texts), self.size), np.zeros(len(texts), np.int64)
        active = np.flatnonzero(place >= 0)
        while len(active):
            l, h, q = lo[active], hi[active], size[active]
            symbol = data[starts[active] + place[active]]
            left, right = self.tree.counts(symbol, l, h)
            left, right = left + self.less[symbol], right + self.less[symbol]
            found = self.weight[right] - self.weight[left] >= least
            stuck = ~found & (q == 0)
            done = active[found | stuck]
            lo[active[found]], hi[active[found]], size[active[found]] = left[found], right[found], q[found] + 1
            out[starts[done] + place[done]] = size[done]
            place[done] -= 1
            if (shorten := ~found & ~stuck).any():
                l, h = l[shorten], h[shorten]
                depth = np.maximum(self.low[0][l], self.low[0][h]).clip(0)
                depth = np.minimum(depth, q[shorten] - 1)
                l, h = self._widen(l, h, depth)
                lo[active[shorten]], hi[active[shorten]], size[active[shorten]] = l, h, depth
            active = active[place[active] >= 0]
        return out
