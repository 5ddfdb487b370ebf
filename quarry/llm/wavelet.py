"""Wavelet matrix over token ids: bit-planes with ranks, in one compressed file.

File: magic, then a header (ids, planes, documents; zeros of each plane), the documents' ids and lengths, and the planes,
highest bit first, each compressed by itself and opened only when asked for. The directory of ranks has two levels, ones
before each superblock of 65,536 bits and, in 16 bits, before each block of 512 bits in it: 3 % of the plane. It takes one
pass of popcounts, so that it is made on opening and not stored.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WVM1"
HEAD = struct.Struct("<4sQII")
#: Bits of a word, words of a block, blocks of a superblock.
WORD, BLOCK, SUPER = 64, 8, 128


class Plane:
    """Bits with rank and select."""

    def __init__(self, packed: np.ndarray, n: int):
        self.n = n
        step = WORD // 8 * BLOCK
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % step or step * (not len(packed))), "<u8")

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    @cached_property
    def _blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each superblock, and before each block within its superblock."""
        ones = np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(ones)))
        supers = total[:-1:SUPER].copy()
        return supers, (total[:-1] - np.repeat(supers, SUPER)[: len(ones)]).astype(np.uint16)

    def get(self, i: int) -> int:
        return int(self.words[i // WORD]) >> (i % WORD) & 1

    def _before(self, bit: int, block: int) -> int:
        """How many bits before a block are bit."""
        supers, within = self._blocks
        ones = int(supers[block // SUPER]) + int(within[block])
        return ones if bit else block * BLOCK * WORD - ones

    def rank(self, bit: int, i: int) -> int:
        """How many of the first i bits are bit."""
        w, r = divmod(i, WORD)
        block = min(w // BLOCK, len(self._blocks[1]) - 1)
        ones = self._before(1, block) + sum(int(x).bit_count() for x in self.words[block * BLOCK : w])
        ones += (int(self.words[w]) & ((1 << r) - 1)).bit_count() if r else 0
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Where the bit of rank k (from 0) is: halving over blocks, then words, then bits."""
        low, high = 0, len(self._blocks[1])
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._before(bit, mid) <= k else (low, mid)
        left = k - self._before(bit, low)
        for w in range(low * BLOCK, len(self.words)):
            word = int(self.words[w])
            word = word if bit else ~word & (1 << WORD) - 1
            if left < word.bit_count():
                break
            left -= word.bit_count()
        for _ in range(left):
            word &= word - 1
        return w * WORD + (word & -word).bit_length() - 1


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], doc_ids: np.ndarray, lengths: np.ndarray, raw: list[bytes]):
        self.n, self.zeros, self.doc_ids, self.lengths, self._raw = n, zeros, doc_ids, lengths, raw
        self._planes: dict[int, Plane] = {}

    @property
    def n_planes(self) -> int:
        return len(self.zeros)

    def plane(self, k: int) -> Plane:
        if k not in self._planes:
            self._planes[k] = Plane(np.frombuffer(zstandard.decompress(self._raw[k]), np.uint8), self.n)
        return self._planes[k]

    @staticmethod
    def write(ids: np.ndarray, doc_ids, lengths, n_planes: int) -> bytes:
        """The file of ids, each below 2 ** n_planes; the lengths of the documents add up to them. A document without id is -1 << 63."""
        x = np.ascontiguousarray(ids, np.uint16 if n_planes <= 16 else np.uint32)
        zeros, raw = [], []
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(n_planes - 1, -1, -1):
            bit = (x >> k) & 1 == 1
            raw.append(pack(np.packbits(bit, bitorder="little").tobytes()))
            low = x[np.flatnonzero(~bit)]
            zeros.append(len(low))
            x = np.concatenate((low, x[np.flatnonzero(bit)]))
        docs = [pack(np.asarray(v, "<i8").tobytes()) for v in (doc_ids, lengths)]
        sizes = np.array([len(b) for b in (*docs, *raw)], "<u8")
        return b"".join([HEAD.pack(MAGIC, len(ids), n_planes, len(doc_ids)), np.array(zeros, "<u8").tobytes(), sizes.tobytes(), *docs, *raw])

    @classmethod
    def read(cls, file: bytes) -> WaveletMatrix:
        magic, n, n_planes, _ = HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEAD.size + 8 * n_planes
        zeros = np.frombuffer(file, "<u8", n_planes, HEAD.size).tolist()
        sizes = np.frombuffer(file, "<u8", n_planes + 2, at).tolist()
        at += 8 * (n_planes + 2)
        parts = []
        for s in sizes:
            parts.append(file[at : at + s])
            at += s
        docs = [np.frombuffer(zstandard.decompress(b), "<i8") for b in parts[:2]]
        return cls(n, zeros, *docs, parts[2:])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last."""
        x = np.zeros(self.n, np.uint16 if self.n_planes <= 16 else np.uint32)
        for k in range(self.n_planes - 1, -1, -1):
            bit, z = self.plane(k).bits, self.zeros[k]
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[:z]
            y[np.flatnonzero(bit)] = x[z:] | x.dtype.type(1 << (self.n_planes - 1 - k))
            x = y
        return x

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k in range(self.n_planes):
            p = self.plane(k)
            bit = p.get(i)
            out = out << 1 | bit
            i = self.zeros[k] * bit + p.rank(bit, i)
        return out

    def _span(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of token among the first i places begin and end in the lowest order."""
        a, b = 0, i
        for k in range(self.n_planes):
            bit, p = token >> self.n_planes - 1 - k & 1, self.plane(k)
            a, b = (self.zeros[k] * bit + p.rank(bit, j) for j in (a, b))
        return a, b

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of token in places start to stop."""
        stop = self.n if stop is None else stop
        if token < 0 or token >> self.n_planes:
            return 0
        a, b = self._span(token, stop)
        return b - a - (self._span(token, start)[1] - self._span(token, start)[0] if start else 0)

    def find(self, token: int, k: int) -> int:
        """The place of occurrence k (from 0) of token; -1 if there are fewer."""
        if token < 0 or token >> self.n_planes:
            return -1
        a, b = self._span(token, self.n)
        i = a + k
        if not a <= i < b:
            return -1
        for level in range(self.n_planes - 1, -1, -1):
            bit = token >> self.n_planes - 1 - level & 1
            i = self.plane(level).select(bit, i - self.zeros[level] * bit)
        return i
