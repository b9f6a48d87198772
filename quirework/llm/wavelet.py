"""A wavelet matrix in one compressed file: access, counting and occurrence lookup of token ids.

File format (little-endian): magic "QWM1"; unsigned 64-bit numbers of tokens and of documents; unsigned 32-bit bits of
a token; then for each section an unsigned 64-bit length and the section: the index (zlib: for every document its id as
signed 64-bit, a validity byte, its length as unsigned 64-bit; for every plane the unsigned 64-bit number of zeros;
for every plane and chunk the unsigned 64-bit ones before the chunk and the end of the chunk's bytes), then the planes'
chunks, each a Zstandard frame. Plane 0 holds the highest bit. To look up one token, one chunk a plane is read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

MAGIC = b"QWM1"
#: Bits of a plane that are compressed together.
CHUNK = 1 << 15


def _partition(values: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """(bit plane, zeros) from the highest bit down; each plane sorts the values stably by its bit."""
    planes = []
    for k in range(bits - 1, -1, -1):
        bit = (values & values.dtype.type(1 << k)) != 0
        low = np.flatnonzero(~bit)  # places and take() are several times faster than a mask of random bits
        planes.append((np.packbits(bit), len(low)))
        values = values.take(np.concatenate((low, np.flatnonzero(bit))))
    return planes


def build(tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int], bits: int) -> bytes:
    """The file of one shard: tokens of its documents one after another."""
    n = len(tokens)
    step, chunks, ends, before = CHUNK // 8, [], [], []
    planes = _partition(tokens, bits)
    press, size = zstandard.ZstdCompressor(level=1).compress, 0
    for plane, _ in planes:
        raw, ones = plane.tobytes(), 0
        for at in range(0, len(raw), step):
            part = raw[at : at + step]
            before.append(ones)
            ones += int(np.bitwise_count(np.frombuffer(part, np.uint8)).sum())
            chunks.append(press(part))
            size += len(chunks[-1])
            ends.append(size)
    index = zlib.compress(
        np.array([i or 0 for i in doc_ids], "<i8").tobytes()
        + bytes(i is not None for i in doc_ids)
        + np.array(lengths, "<u8").tobytes()
        + np.array([z for _, z in planes], "<u8").tobytes()
        + np.array(before, "<u8").tobytes()
        + np.array(ends, "<u8").tobytes(),
        1,
    )
    body = b"".join(chunks)
    return b"".join((MAGIC, struct.pack("<QQI", n, len(doc_ids), bits), struct.pack("<Q", len(index)), index, struct.pack("<Q", len(body)), body))


class Shard:
    """A reader of one file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, docs, self.bits = struct.unpack_from("<QQI", data, 4)
        (size,) = struct.unpack_from("<Q", data, 24)
        index = zlib.decompress(data[32 : 32 + size])
        self.body = memoryview(data)[40 + size :]
        per = -(-(-(-self.n // 8)) // (CHUNK // 8))
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, count, at)
            at += out.nbytes
            return out

        ids, valid = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(i) if v else None for i, v in zip(ids, valid, strict=True)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.zeros = take("<u8", self.bits).astype(np.int64)
        self.before = take("<u8", self.bits * per).astype(np.int64).reshape(self.bits, per)
        ends = take("<u8", self.bits * per).astype(np.int64)
        self.ends = ends.reshape(self.bits, per)
        self.begins = np.concatenate(([0], ends[:-1])).reshape(self.bits, per) if per else self.ends
        self._open = zstandard.ZstdDecompressor().decompress
        self._chunks: dict[tuple[int, int], np.ndarray] = {}

    def _chunk(self, plane: int, chunk: int) -> np.ndarray:
        key = (plane, chunk)
        if key not in self._chunks:
            if len(self._chunks) >= 256:
                self._chunks.clear()
            self._chunks[key] = np.unpackbits(np.frombuffer(self._open(self.body[self.begins[key] : self.ends[key]]), np.uint8))
        return self._chunks[key]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        chunk, at = divmod(i, CHUNK)
        if chunk == self.before.shape[1]:
            return self.n - int(self.zeros[plane])
        return int(self.before[plane, chunk]) + (int(self._chunk(plane, chunk)[:at].sum()) if at else 0)

    def token(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = int(self._chunk(p, i // CHUNK)[i % CHUNK])
            ones = self._ones(p, i)
            value = value << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        """The places of the token's first occurrences, up to place i, in the order below the last plane."""
        low, high = 0, i
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, stop: int | None = None) -> int:
        """Occurrences of a token among the first `stop` places, all by default."""
        low, high = self._interval(token, self.n if stop is None else stop)
        return high - low

    def _find(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th bit of that value, from 0, in a plane."""
        held = self.before[plane] if bit else np.arange(self.before.shape[1]) * CHUNK - self.before[plane]
        chunk = int(np.searchsorted(held, k, side="right")) - 1
        return chunk * CHUNK + int(np.flatnonzero(self._chunk(plane, chunk) == bit)[k - int(held[chunk])])

    def place(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0."""
        low, high = self._interval(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._find(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the planes' stable sorts from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            raw = b"".join(self._open(self.body[a:b]) for a, b in zip(self.begins[p], self.ends[p], strict=True))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).astype(bool)
            zeros, above = int(self.zeros[p]), np.empty(self.n, kind)
            above[np.flatnonzero(~bit)] = values[:zeros]
            above[np.flatnonzero(bit)] = values[zeros:] | kind(1 << (self.bits - 1 - p))
            values = above
        return values

    def documents(self):
        """(id, first place, tokens) of every document."""
        tokens, at = self.tokens(), 0
        for i, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            yield i, at, tokens[at : at + n]
            at += n
