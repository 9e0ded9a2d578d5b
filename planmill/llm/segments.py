"""Whole texts as sequences of segments that a byte-level BPE encodes independently.

A segment ends before a single space that stands before a character other than white space. The
split pattern of byte-level BPE can never match across such a place: runs of other characters
take a space only in front, and a run of white space leaves its last space to what follows. So the
ids of a text are the ids of its segments in a row, and a segment is encoded once for all its
occurrences in the work of a task.
"""

import itertools
import re

import numpy as np

_UNSAFE = re.compile(r" (?!\S)")
_BOUNDARY = re.compile(r"(?= \S)")


def segments(text: str) -> list[str]:
    """Segments of a text, in order; they join to the text. An empty text has none."""
    if not text:
        return []
    if "\x00" in text or _UNSAFE.search(text):
        return [s for s in _BOUNDARY.split(text) if s]
    parts = text.replace(" ", "\x00 ").split("\x00")
    return parts if parts[0] else parts[1:]


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[s:s+n] for each (s, n), one after the other."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    first = np.cumsum(lens) - lens
    return flat[np.repeat(starts - first, lens) + np.arange(total)]


class SegmentCodes:
    """Ids of segments, filled as segments turn up; starts anew beyond `limit` entries.

    `encode_many(list of segments)` gives (all ids, ids of each). The limit bounds memory only:
    forgotten segments are encoded again.
    """

    def __init__(self, encode_many, limit: int = 1_000_000):
        self.encode_many, self.limit = encode_many, limit
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(0, np.int64)
        self.lens = np.zeros(0, np.int64)

    def learn(self, wanted) -> None:
        """Encode those of the wanted segments that are not known yet."""
        index = self.index
        new = [s for s in wanted if s not in index]
        if len(index) + len(new) > self.limit and index:
            self._clear()
            index, new = self.index, list(wanted)
        if not new:
            return
        flat, lens = self.encode_many(new)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lens) - lens])
        self.lens = np.concatenate([self.lens, lens])
        self.used += len(flat)
        n = len(index)
        index.update(zip(new, range(n, n + len(new)), strict=True))

    def numbers(self, flat: list[str]) -> np.ndarray:
        """Number of each segment, known or not: one lookup a segment, and only those not found are learnt."""
        found = list(map(self.index.get, flat))
        if None in found:
            missed = [k for k, i in enumerate(found) if i is None]
            new = list(dict.fromkeys([flat[k] for k in missed]))
            if len(self.index) + len(new) > self.limit and self.index:
                new, missed = list(dict.fromkeys(flat)), range(len(flat))  # `learn` starts anew with these
            self.learn(new)
            for k in missed:
                found[k] = self.index[flat[k]]
        return np.array(found, np.int64)

    def encode_any(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each document) of documents whose segments need not be known."""
        rows = self.numbers(list(itertools.chain.from_iterable(parts)))
        lens = self.lens[rows]
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = total[np.concatenate([[0], np.cumsum([len(doc) for doc in parts])])]
        return gather(self.flat, self.starts[rows], lens), np.diff(bounds)

    def encode(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each document) of documents whose segments are all known."""
        get = self.index.__getitem__
        rows = np.array([get(s) for doc in parts for s in doc], np.int64)
        lens = self.lens[rows]
        ends = np.cumsum([len(doc) for doc in parts])
        total = np.concatenate([[0], np.cumsum(lens)])
        bounds = total[np.concatenate([[0], ends])]
        return gather(self.flat, self.starts[rows], lens), np.diff(bounds)


def in_parts(batches, rows: int = 1024):
    """The batches in slices of at most `rows`, so that only few texts are Python strings at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def text_groups(texts: list, size: int) -> list[list[str]]:
    """Neighbouring texts (null: empty) in groups of about `size` characters."""
    groups, group, held = [], [], 0
    for t in texts:
        group.append(t or "")
        held += len(group[-1])
        if held >= size:
            groups.append(group)
            group, held = [], 0
    if group:
        groups.append(group)
    return groups
