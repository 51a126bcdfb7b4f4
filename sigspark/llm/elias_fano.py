"""Elias-Fano sequences and the two-level n-gram trie on top of them.

Everything is one block of bytes with views into it, so a sequence can be
opened over an Arrow buffer or a memory-mapped file without a copy.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class EliasFano:
    """A non-decreasing sequence of n numbers below ``universe``.

    The low ``l`` bits of each number are packed one after the other; the
    high parts are a bit per number and a zero per step of the high part:
    about 2 + log2(universe / n) bits a number. A running count of ones per
    64 bits makes ``select`` a sorted search.
    """

    def __init__(self, buf, at: int = 0):
        head = np.frombuffer(buf, "<u8", 4, at)
        self.n, self.l, words, lows = (int(x) for x in head)
        at += 32
        self.words = np.frombuffer(buf, "<u8", words, at)
        at += 8 * words
        self.rank = np.frombuffer(buf, "<u4", words + 1, at)
        at += 4 * (words + 1) + (-4 * (words + 1)) % 8
        # the 8 bytes that begin at each byte, without a copy
        self.low = np.ndarray((lows - 7,), "<u8", buffer=buf, offset=at, strides=(1,))
        self.end = at + lows
        self.buckets = words * 64 - self.n
        self.zeros = 64 * np.arange(words + 1, dtype=np.int64) - self.rank

    @staticmethod
    def pack(x: np.ndarray, universe: int) -> bytes:
        """Bytes of sorted ``x``; their number is a multiple of 8."""
        x = x.astype(np.uint64)
        n = len(x)
        l = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        high = (x >> _U(l)).astype(np.int64)
        size = n + ((universe - 1) >> l) + 1
        words = -(-size // 64) + 1
        bits = np.zeros(words * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        ones = np.zeros(words + 1, "<u4")
        ones[1:] = np.cumsum(bits.reshape(words, 64).sum(1, dtype=np.int64))
        lows, place = [], np.arange(l, dtype=np.uint64)
        for lo in range(0, n if l else 0, 1 << 14):
            part = x[lo:lo + (1 << 14), None] >> place & _U(1)
            lows.append(np.packbits(part.astype(np.uint8).ravel(), bitorder="little"))
        low = b"".join(p.tobytes() for p in lows) + bytes(16)
        low += bytes(-len(low) % 8)
        out = np.array([n, l, words, len(low)], "<u8").tobytes() + packed.tobytes() + ones.tobytes()
        return out + bytes(-len(out) % 8) + low

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th (from 0) bit; ``counts``: such bits before each word."""
        w = np.searchsorted(counts, k, "right") - 1
        word = ~self.words[w] if flip else self.words[w]
        rest = (k - counts[w]).astype(np.uint64)
        place = w * 64
        for width in (32, 16, 8, 4, 2, 1):  # halve the part of the word that holds it
            ones = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.uint64)
            up = rest >= ones
            rest = np.where(up, rest - ones, rest)
            word = np.where(up, word >> _U(width), word)
            place += np.where(up, width, 0)
        return place

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if self.l == 0:
            return np.zeros(len(i), np.uint64)
        off = i * self.l
        return self.low[off >> 3] >> (off & 7).astype(np.uint64) & _U((1 << self.l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = self._select(self.rank, i, False) - i
        return high.astype(np.uint64) << _U(self.l) | self._lows(i)

    def all(self) -> np.ndarray:
        bits = np.unpackbits(self.words.view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits)[:self.n]
        i = np.arange(self.n)
        out = (at - i).astype(np.uint64) << _U(self.l)
        for lo in range(0, self.n, 1 << 18):
            out[lo:lo + (1 << 18)] |= self._lows(i[lo:lo + (1 << 18)])
        return out

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first number >= x, n if none; whether it equals x)."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), self.n), np.zeros(len(x), bool)
        h = (x >> _U(self.l)).astype(np.int64)
        beyond = h >= self.buckets
        h = np.minimum(h, self.buckets - 1)
        stop = self._select(self.zeros, h, True) - h
        i = np.where(h > 0, self._select(self.zeros, np.maximum(h - 1, 0), True) - np.maximum(h - 1, 0), 0)
        want = x & _U((1 << self.l) - 1) if self.l else np.zeros(len(x), np.uint64)
        equal = np.zeros(len(x), bool)
        on = np.flatnonzero((i < stop) & ~beyond)
        while len(on):
            low = self._lows(i[on])
            equal[on] = low == want[on]
            less = low < want[on]
            i[on[less]] += 1
            on = on[less]
            on = on[i[on] < stop[on]]
        return np.where(beyond, self.n, i), equal


#: A bigram key is CONTEXT_BITS of its context's hash, then a hash of both words.
CONTEXT_BITS = 26
_REST = _U(64 - CONTEXT_BITS)


class Trie:
    """One shard of the n-gram counts, as bytes (``build``) or opened.

    Level 1: word hashes with exact counts. Level 2, in three sequences: the
    context slots that occur, where each slot's successors begin, and the
    successors. These are made monotone by adding the last value of the slot
    before, so a search is relative to its context. Each successor has one
    byte, the quantised probability of its bigram.
    """

    def __init__(self, buf):
        self.words = EliasFano(buf)
        n = self.words.n
        self.counts = np.frombuffer(buf, "<u8", n, self.words.end)
        self.slots = EliasFano(buf, self.words.end + 8 * n)
        self.starts = EliasFano(buf, self.slots.end)
        self.next = EliasFano(buf, self.starts.end)
        self.codes = np.frombuffer(buf, np.uint8, self.next.n, self.next.end)

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, bigrams: np.ndarray, codes: np.ndarray) -> bytes:
        """From sorted distinct word hashes and bigram keys."""
        slot = (bigrams >> _REST).astype(np.int64)
        rest = bigrams & _U((1 << int(_REST)) - 1)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        lasts = rest[np.concatenate([first[1:], [len(slot)]]) - 1] if len(slot) else rest
        base = np.cumsum(lasts) - lasts
        lengths = np.diff(np.concatenate([first, [len(slot)]])) if len(slot) else first
        total = int(lasts.sum()) + 1
        return b"".join([
            EliasFano.pack(words, 1 << 64), counts.astype("<u8").tobytes(),
            EliasFano.pack(slot[first], 1 << CONTEXT_BITS),
            EliasFano.pack(np.concatenate([first, [len(slot)]]), len(slot) + 1),
            EliasFano.pack(rest + np.repeat(base, lengths), total), codes.astype(np.uint8).tobytes()])

    def count(self, words: np.ndarray) -> np.ndarray:
        i, hit = self.words.successor(words)
        out = np.zeros(len(words), np.uint64)
        out[hit] = self.counts[i[hit]]
        return out

    def code(self, bigrams: np.ndarray) -> np.ndarray:
        """Quantised probability of each key, 0 where it does not occur."""
        out = np.zeros(len(bigrams), np.uint8)
        if not len(bigrams) or not self.next.n:
            return out
        slot = bigrams >> _REST
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))  # sorted keys share slots
        k, hit = self.slots.successor(slot[first])
        k = np.where(hit, k, 0)
        lo = self.starts[k].astype(np.int64)
        hi = np.where(hit, self.starts[k + 1].astype(np.int64), lo)
        base = np.where(lo > 0, self.next[np.maximum(lo - 1, 0)], _U(0))
        times = np.diff(np.concatenate([first, [len(bigrams)]]))
        lo, hi, base = (np.repeat(x, times) for x in (lo, hi, base))
        at = np.flatnonzero(hi > lo)
        lo, hi = lo[at], hi[at]
        want = (bigrams[at] & _U((1 << int(_REST)) - 1)) + base[at]
        i, same = self.next.successor(want)
        # of equal numbers the search gives the first, which may end the slot before
        early = np.flatnonzero(same & (i < lo))
        i[early] = lo[early]
        same[early] = self.next[i[early]] == want[early]
        good = same & (i >= lo) & (i < hi)
        out[at[good]] = self.codes[i[good]]
        return out
