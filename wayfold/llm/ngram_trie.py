"""Compact n-gram trie levels: Elias-Fano monotone sequences in a memory-mapped file.

Level 1 holds the words of a shard (sorted keys, counts) and monotone pointers into level 2. Level 2 holds, for each
word, the contexts it was seen in, sorted inside the word's pointer range and made monotone over all words by
the word's rank; level 3 holds, for each pair, the contexts before it in the same way. Next to them stand quantised
logarithms of the smoothed probability, one byte each. A search takes a parent's range and looks for the successor of
a context relative to it.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import U64

ONE = U64(1)


class EliasFano:
    """A sorted sequence of n unsigned numbers: low bits packed, high bits in unary, zeros counted per 64 bits."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.zeros = n, bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(58, max(0, (top // max(n, 1)).bit_length() - 1))
        upper = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        length = (int(upper[-1]) if n else 0) + 2
        flags = np.zeros((length + 63) // 64 * 64, np.uint8)
        flags[upper] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits:
            part = values & U64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        return cls(n, bits, low, high, zeros)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> shift
        over = shift + U64(self.bits) > 64
        out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return out & U64((1 << self.bits) - 1)

    @staticmethod
    def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of each word, by halving."""
        place = np.zeros(len(word), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(word & U64((1 << half) - 1)).astype(np.int64)
            up = k >= ones
            k = np.where(up, k - ones, k)
            word = np.where(up, word >> U64(half), word)
            place += up * half
        return place

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        w = np.minimum(w, len(self.high) - 1)
        return w * 64 + self._in_word(~self.high[w], k - self.zeros[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        w = np.searchsorted(ones, i, "right") - 1
        place = w * 64 + self._in_word(self.high[w], i - ones[w])
        return ((place - i).astype(U64) << U64(self.bits)) | self.low_of(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Index of each x between lo and hi, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        part = (x >> U64(self.bits)).astype(np.int64)
        whole = int(self.zeros[-1])
        inside = part < whole
        p = np.where(inside, part, 0)
        a = np.where(p > 0, self._zero(np.maximum(p - 1, 0)) - (p - 1), 0)
        b = np.minimum(self._zero(p) - p, self.n)
        a = a if lo is None else np.maximum(a, lo)
        b = b if hi is None else np.minimum(b, hi)
        b = np.where(inside, b, a)
        want, end = x & U64((1 << self.bits) - 1), b.copy()
        live = np.flatnonzero(a < b)
        while len(live):  # first low part that is not smaller
            mid = (a[live] + b[live]) >> 1
            less = self.low_of(mid) < want[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        out = np.where(a < end, a, -1)
        ok = out >= 0
        out[ok] = np.where(self.low_of(out[ok]) == want[ok], out[ok], -1)
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "zeros": self.zeros}


class Trie:
    """words -> counts and pair ranges; (word, context) -> two codes and a triple range; (pair, earlier context) -> code.

    Codes are logarithms in steps of one byte: a pair's and a triple's gain over the level below, and a pair's weight as
    the context of what follows it.
    """

    CODES = ("gain2", "norm2", "gain3")

    def __init__(self, levels: dict[str, np.ndarray]):
        ef = lambda k: EliasFano(*map(int, levels[k + ".meta"]), levels[k + ".low"], levels[k + ".high"], levels[k + ".zeros"])
        self.words, self.pointers, self.contexts, self.pointers3, self.contexts3 = map(ef, ("words", "pointers", "contexts", "pointers3", "contexts3"))
        self.counts = levels["counts"]
        self.codes = {k: (levels[k], *map(float, levels[k + ".scale"])) for k in self.CODES}

    @staticmethod
    def levels(words: np.ndarray, counts: np.ndarray, pairs: tuple, triples: tuple, **values: np.ndarray) -> dict[str, np.ndarray]:
        """words: sorted 64-bit keys; pairs: sorted (word's rank, 32-bit context key); triples: sorted (pair's rank, 32-bit
        context key); values: gain2 and norm2 of the pairs, gain3 of the triples."""
        parts = {"words": EliasFano.build(words >> ONE)}
        for suffix, (rank, context), above in (("", pairs, len(words)), ("3", triples, len(pairs[0]))):
            parts["pointers" + suffix] = EliasFano.build(np.searchsorted(rank, np.arange(above + 1)).astype(U64))
            parts["contexts" + suffix] = EliasFano.build((rank.astype(U64) << U64(32)) | context.astype(U64))
        out = {f"{k}.{name}": a for k, ef in parts.items() for name, a in ef.arrays().items()} | {"counts": counts.astype(np.int64)}
        for k in Trie.CODES:
            v = values[k]
            low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
            step = max(high - low, 1e-9) / 255
            out |= {k: np.rint((v - low) / step).astype(np.uint8), k + ".scale": np.array([low, step])}
        return out

    @classmethod
    def mapped(cls, levels: dict[str, np.ndarray]) -> Trie:
        """Write the levels to one unnamed file (gone with its map) and open them as memory maps. Only the task that
        builds a shard reads it."""
        out = {}
        with tempfile.TemporaryFile() as f:
            spans = {}
            for k, a in levels.items():
                f.seek(-(-f.tell() // 8) * 8)
                spans[k] = (f.tell(), a.dtype, a.shape)
                f.write(np.ascontiguousarray(a).tobytes())
            f.flush()
            for k, (at, dtype, shape) in spans.items():
                out[k] = np.memmap(f, dtype, "r", at, shape) if shape[0] else np.zeros(shape, dtype)
        return cls(out)

    def word_rank(self, words: np.ndarray) -> np.ndarray:
        return self.words.find(words >> ONE)

    @staticmethod
    def _below(pointers: EliasFano, contexts: EliasFano, rank: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Rank of each context in the range of its parent, or -1 (also where the parent is)."""
        out = np.full(len(rank), -1)
        for lo in range(0, len(rank), 1 << 18):
            known = lo + np.flatnonzero(rank[lo : lo + (1 << 18)] >= 0)
            if len(known):
                r = rank[known]
                each, back = np.unique(r, return_inverse=True)
                start, end = pointers.get(each).astype(np.int64)[back], pointers.get(each + 1).astype(np.int64)[back]
                out[known] = contexts.find((r.astype(U64) << U64(32)) | context[known].astype(U64), start, end)
        return out

    def pair(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self._below(self.pointers, self.contexts, word, context)

    def triple(self, pair: np.ndarray, context: np.ndarray) -> np.ndarray:
        return self._below(self.pointers3, self.contexts3, pair, context)

    def value(self, name: str, at: np.ndarray) -> np.ndarray:
        code, low, step = self.codes[name]
        return low + code[at] * step
