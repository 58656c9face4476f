"""Elias-Fano coding of non-decreasing integers, with a select that needs no table of 64-bit offsets."""

from __future__ import annotations

import numpy as np

SAMPLE = 256
_U = np.uint64


class EliasFano:
    """n non-decreasing integers in about 2 + log2(range / n) bits each; ``value(i)`` and ``select`` give them back.

    Each number's low bits stand in a packed array; its high part is the place of its one in a bit string, in
    unary. ``value`` finds the i-th one from a table of every 256th one (32 bits an entry); ``select`` finds many
    together, from 32-bit counts of the ones before each word of the string.
    """

    def __init__(self, n: int, base: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        if not len(v):
            return cls(0, 0, 0, b"", b"", b"")
        if (np.diff(v) < 0).any():
            raise ValueError("values must not decrease")
        base = int(v[0])
        u = v.astype(_U) - _U(base & (2**64 - 1))
        bits = max(0, (int(u[-1]) // len(v)).bit_length() - 1)
        low = np.packbits(((u[:, None] >> np.arange(bits, dtype=_U)) & _U(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (u >> _U(bits)).astype(np.int64) + np.arange(len(v))
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(len(v), base, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _ones(self, at: np.ndarray) -> np.ndarray:
        """Place of the ``at``-th ones: the word by its count of ones before, then six halvings of the word."""
        words = np.frombuffer(self.high + bytes(-len(self.high) % 8), "<u8")
        before = np.zeros(len(words) + 1, np.uint32)
        np.cumsum(np.bitwise_count(words), out=before[1:])
        word = np.searchsorted(before, at.astype(np.uint32), "right") - 1
        left, rest = at - before[word], words[word]
        place = np.zeros(len(at), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(rest & _U((1 << half) - 1))
            on = left >= count
            left = left - np.where(on, count, 0)
            rest = np.where(on, rest >> _U(half), rest)
            place += np.where(on, half, 0)
        return word * 64 + place

    def _lows(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the ``at``-th numbers, read from the packed array in parts of up to 32 bits."""
        raw = np.frombuffer(self.low + bytes(9), np.uint8)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        out = np.zeros(len(at), _U)
        for a in range(0, self.low_bits, 32):
            first, size = at * self.low_bits + a, min(32, self.low_bits - a)
            out |= ((eight[first >> 3] >> (first & 7).astype(_U)) & _U((1 << size) - 1)) << _U(a)
        return out

    def select(self, at) -> np.ndarray:
        """The numbers at the places ``at`` (0 to n - 1)."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.int64)
        if at.min() < 0 or at.max() >= self.n:
            raise IndexError(f"places from 0 to {self.n - 1}")
        u = ((self._ones(at) - at).astype(_U) << _U(self.low_bits)) | self._lows(at)
        return (u + _U(self.base & (2**64 - 1))).astype(np.int64)

    def values(self) -> np.ndarray:
        """All numbers."""
        return self.select(np.arange(self.n))

    def value(self, i: int) -> int:
        """The i-th number alone: a sampled place, then a scan over less than 256 ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        have = self.high[byte] >> bit << bit
        while (count := have.bit_count()) <= left:
            left -= count
            byte += 1
            have = self.high[byte]
        for _ in range(left):
            have &= have - 1
        one = byte * 8 + (have & -have).bit_length() - 1
        first = i * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return self.base + (((one - i) << self.low_bits) | (part >> (first % 8)) & ((1 << self.low_bits) - 1))
