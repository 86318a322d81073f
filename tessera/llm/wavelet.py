"""Wavelet matrix of token ids in one compressed byte string: access, rank, select, counting and full decoding."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"TWM2"
#: Bits of a plane that are compressed, and read, together.
BLOCK = 1 << 16
_HEAD = struct.Struct("<4sBxxxQQ")


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, known: np.ndarray | None = None) -> bytes:
    """The file of a shard: header, document table, then for each bit-plane (highest first) its blocks' ranks, places and bits.

    In every plane the ids are in the order that the planes above left: those with a 0 first, each part in its old order.
    ``known`` tells the documents that have an id.
    """
    n, planes = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.ones(len(doc_ids), bool) if known is None else known
    table = squeeze(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<i8").tobytes() + known.tobytes())
    out = [_HEAD.pack(MAGIC, planes, n, len(doc_ids)), struct.pack("<Q", len(table)), table]
    v = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for p in range(planes - 1, -1, -1):
        bits = (v >> v.dtype.type(p)) & v.dtype.type(1) != 0
        zeros, ones = v.compress(~bits), v.compress(bits)
        packed = np.packbits(bits)
        step = BLOCK // 8
        blocks = [squeeze(packed[a : a + step].tobytes()) for a in range(0, max(1, len(packed)), step)]
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if n else np.zeros(1, np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
        places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<i8")
        body = ranks.tobytes() + places.tobytes() + b"".join(blocks)
        out += [struct.pack("<Q", len(body)), body]
        v = np.concatenate([zeros, ones])
    return b"".join(out)


class Shard:
    """Reads a shard's file. Single look-ups decompress only the blocks they touch."""

    def __init__(self, data: bytes):
        magic, self.planes, self.n, self.n_docs = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.data, at = data, _HEAD.size
        (size,) = struct.unpack_from("<Q", data, at)
        raw = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size])
        self.doc_ids, self.lengths = np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, "<i8", self.n_docs, 8 * self.n_docs)
        self.known = np.frombuffer(raw, bool, self.n_docs, 16 * self.n_docs)
        at += 8 + size
        self.blocks = max(1, -(-self.n // BLOCK))
        self.at = []
        for _ in range(self.planes):
            (size,) = struct.unpack_from("<Q", data, at)
            self.at.append(at + 8)
            at += 8 + size
        self.ranks = [np.frombuffer(data, "<i8", self.blocks + 1, a) for a in self.at]
        self.places = [np.frombuffer(data, "<i8", self.blocks + 1, a + 8 * (self.blocks + 1)) for a in self.at]
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]
        self._block = lru_cache(maxsize=64)(self._read)

    def _read(self, plane: int, block: int) -> np.ndarray:
        first = self.at[plane] + 16 * (self.blocks + 1)
        a, b = self.places[plane][block], self.places[plane][block + 1]
        raw = zstandard.ZstdDecompressor().decompress(self.data[first + a : first + b])
        return np.unpackbits(np.frombuffer(raw, np.uint8))[: min(BLOCK, self.n - block * BLOCK)]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        if not rest:
            return int(self.ranks[plane][block])
        return int(self.ranks[plane][block]) + int(self._block(plane, block)[:rest].sum())

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        before = self.ranks[plane] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ranks[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The i-th id."""
        out = 0
        for p in range(self.planes):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the last order holds the ``token``s among the first i ids."""
        if token >> self.planes:
            return 0, 0
        a, b = 0, i
        for p in range(self.planes):
            x, y = self._ones(p, a), self._ones(p, b)
            a, b = (self.zeros[p] + x, self.zeros[p] + y) if token >> (self.planes - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of ``token`` among the first ``upto`` ids, or all."""
        a, b = self._range(token, self.n if upto is None else upto)
        return b - a

    def find(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``token``."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - self.zeros[p] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest to the highest."""
        v = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self._read(p, b) for b in range(self.blocks)]).view(bool) if self.n else np.zeros(0, bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~bits)], up[np.flatnonzero(bits)] = v[: self.zeros[p]], v[self.zeros[p] :]
            up |= bits.astype(v.dtype) << v.dtype.type(self.planes - 1 - p)
            v = up
        return v

    def documents(self):
        """(doc_id or None, first id's place, ids) of each document."""
        ids, at = self.ids(), 0
        for d, n, known in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.known.tolist(), strict=True):
            yield d if known else None, at, ids[at : at + n]
            at += n


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
