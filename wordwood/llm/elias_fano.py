"""Elias-Fano coding of ascending numbers: two bits a number and a few, with random access.

Of each number the low bits stand one after the other; the high bits are written in unary, number
``i`` with high part ``h`` as a one at place ``h + i``. ``select(i)`` finds the i-th one through a
count of the ones before every 512 bits, a 32-bit number each. Nothing is kept as a table of
64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

HEAD = "<QQQ"

# Bits that one entry of the directory stands for.
BLOCK = 512


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, equal ones allowed, as bytes: a multiple of eight."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    low_bits = max(0, (most // n).bit_length() - 1) if n else 0
    shift = np.uint64(low_bits)
    places = (np.uint64(1) << np.arange(low_bits, dtype=np.uint64))[None, :]
    low = np.packbits((values[:, None] & places) != 0, bitorder="little").tobytes()
    ones = (values >> shift).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-((most >> low_bits) + n + 1) // BLOCK) * BLOCK, np.uint8)
    bits[ones] = 1
    counts = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
    before = np.cumsum(counts, dtype=np.uint32) - counts
    high = np.packbits(bits, bitorder="little").tobytes()
    return struct.pack(HEAD, n, low_bits, len(counts)) + _padded(low) + high + _padded(before.tobytes())


class EliasFano:
    """The numbers in what :func:`encode` made; they stay encoded."""

    def __init__(self, data: memoryview | bytes, at: int = 0):
        self.n, self.low_bits, blocks = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        low = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, low, at)
        at += low + -low % 8
        self.high = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at).reshape(-1, BLOCK // 8)
        at += blocks * BLOCK // 8
        self.before = np.frombuffer(data, "<u4", blocks, at)
        self.end = at + blocks * 4 + -(blocks * 4) % 8

    def select(self, which: np.ndarray) -> np.ndarray:
        """The numbers at these places, as unsigned 64 bits."""
        which = np.asarray(which, np.int64)
        block = np.searchsorted(self.before, which, side="right") - 1
        ones = np.unpackbits(self.high[block], axis=1, bitorder="little").cumsum(1, dtype=np.uint16)
        # The first place at which as many ones are passed.
        rank = which - self.before[block] + 1
        inside = (ones < rank[:, None]).sum(1)
        high = (block * BLOCK + inside - which).astype(np.uint64)
        at = which[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
        return (high << np.uint64(self.low_bits)) | low
