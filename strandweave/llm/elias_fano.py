"""Elias-Fano coded non-decreasing sequences, with select.

Each value keeps its low bits in a packed array; the high parts stand as ones in a bit vector, value i's one
at position high(i) + i.  Two bits and the low bits a value, plus one 32-bit sample every ``STEP`` values to
start a select from.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<qqqqi")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """``values`` must be non-decreasing integers; the least is kept apart, so they may be negative."""

    def __init__(self, n: int, base: int, top: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.top, self.width, self.low, self.high, self.samples = n, base, top, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        base = int(values[0]) if n else 0
        rest = (values.view(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)) if n else np.zeros(0, np.uint64)
        top = int(rest[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
        low = np.packbits(bits.ravel(), bitorder="little")
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(ones[-1]) if n else 0) + 8) // 8 * 8, np.uint8)
        unary[ones] = 1
        return cls(n, base, top, width, low, np.packbits(unary, bitorder="little"), ones[::STEP].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            at = i * self.width + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Value i: from the sample below, whole bytes are skipped by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STEP]), i % STEP
        byte = at >> 3
        seen = int(_POPCOUNT[self.high[byte] & ((1 << (at & 7)) - 1)])
        left += seen
        while (ones := int(_POPCOUNT[self.high[byte]])) <= left:
            left -= ones
            byte += 1
        spot = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left]
        part = ((byte << 3) + int(spot) - i) << self.width
        return self.base + part + int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        index = np.arange(self.n)
        rest = ((ones - index).astype(np.uint64) << np.uint64(self.width)) | self._low(index)
        return (rest + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.base, self.top, len(self.high), self.width) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, top, highs, width = _HEAD.unpack_from(data)
        at = _HEAD.size
        lows = (n * width + 7) // 8
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, base, top, width, low, high, np.frombuffer(data, "<u4", -(-n // STEP), at + lows + highs))
