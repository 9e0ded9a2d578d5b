"""FM-index over a row of integers: wavelet-matrix ranks, backward search, sampled locations."""

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the compared length until all differ."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        values, rank = np.unique(rank * np.int64(n + 1) + follow, return_inverse=True)
        if len(values) == n:
            break
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FmIndex:
    """Index of symbols >= 1; symbol 0 is the end, which the index adds."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        self.levels = []
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            ones = (bwt >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, zeros))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `at` symbols of the transform."""
        begin = np.zeros(len(at), np.int64)
        for bit, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            all_zeros = zeros[-1]
            at = np.where(one, all_zeros + at - zeros[at], zeros[at])
            begin = np.where(one, all_zeros + begin - zeros[begin], zeros[begin])
        return at - begin

    def _symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for bit, zeros in self.levels:
            one = zeros[at + 1] == zeros[at]
            out |= one.astype(np.int64) << bit
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, past-last) suffix rows of each pattern of one length; patterns are rows."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero((patterns < len(self.first) - 1).all(axis=1))
        low[:], ends = 0, high.copy()
        high[:] = 0
        a, b = np.zeros(len(live), np.int64), ends[live]
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            a, b = self.first[c] + self.rank(c, a), self.first[c] + self.rank(c, b)
            some = a < b
            live, a, b = live[some], a[some], b[some]
        low[live], high[live] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: steps back to the next sampled row."""
        place = np.full(len(rows), -1, np.int64)
        at, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            done = self.sampled[at]
            place[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            c = self._symbol(at)
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return place
