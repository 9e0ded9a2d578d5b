"""Wavelet matrix over small symbols: bit planes as 64-bit words with counts in front of each word."""

import numpy as np


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a row of n symbols; about bits * 3 / 16 bytes a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.planes = []
        row = symbols.astype(np.uint8)
        for bit in range(bits - 1, -1, -1):
            ones = (row >> bit) & 1
            packed = np.packbits(ones, bitorder="little")
            words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), "<u8")
            ahead = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            total = int(ahead[-1])
            self.planes.append((words, ahead, self.n - total))
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    @staticmethod
    def _ones(words, ahead, at):
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ahead[word] + np.bitwise_count(words[word] & below).astype(np.int64)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of a symbol among the first `at` symbols, for each place."""
        begin = np.zeros(1, np.int64)
        at = np.asarray(at, np.int64)
        for (words, ahead, zeros), bit in zip(self.planes, range(self.bits - 1, -1, -1), strict=True):
            ones_at, ones_begin = self._ones(words, ahead, at), self._ones(words, ahead, begin)
            if symbol >> bit & 1:
                at, begin = zeros + ones_at, zeros + ones_begin
            else:
                at, begin = at - ones_at, begin - ones_begin
        return at - begin

    def count(self, symbols, at: np.ndarray) -> np.ndarray:
        """Occurrences of any of the symbols among the first `at` symbols."""
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), np.int64))

    def find(self, symbols, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each row the smallest place in low..high with `wanted` of the symbols before it, by bisection.

        The count at `low` is at most `wanted` and that at `high` at least.
        """
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.count(symbols, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low
