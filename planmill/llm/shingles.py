"""Sets of five-word shingles and their min-max signatures."""

import numpy as np
import xxhash

WORDS = 5
PERMUTATIONS = 64
BAND = 4

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hashes = _WordHashes()


def finish(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted different shingle hashes of each text.

    A-Z are lower-cased; words are runs of other bytes than white space (0x20, 0x09-0x0D). A text of
    fewer than five words has its whole sequence as one shingle; without words it has none.
    """
    get = _word_hashes.__getitem__
    docs = [t.encode("utf-8").lower().split() for t in texts]
    sizes = [len(d) for d in docs]
    words = np.array([get(w) for d in docs for w in d], np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = words[: max(0, len(words) - WORDS + 1)].copy()
        for i in range(1, WORDS):
            rolled *= _MULTIPLIER
            rolled += words[i : i + len(rolled)]
        rolled = finish(rolled + np.uint64(WORDS))
        for n in sizes:
            if n >= WORDS:
                out.append(np.unique(rolled[at : at + n - WORDS + 1]))
            elif n:
                value = np.zeros(1, np.uint64)
                for w in words[at : at + n]:
                    value = value * _MULTIPLIER + w
                out.append(finish(value + np.uint64(n)))
            else:
                out.append(words[:0])
            at += n
    return out


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240905)
    masks = draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)
    return masks, draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys of 2 * PERMUTATIONS / BAND bands for each set, none of them empty (int64 matrix).

    Every permutation is evaluated once and gives two values of the signature, the smallest and the
    largest of the set. A band takes four of one kind from four permutations, so that two sets of
    similarity s agree in a band with probability s^4; with 32 bands a pair of similarity 0.75 is
    missed about once in 190,000 times.
    """
    masks, factors = _constants()
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    low = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    high = np.empty_like(low)
    with np.errstate(over="ignore"):
        for p in range(PERMUTATIONS):
            values = (flat ^ masks[p]) * factors[p]
            low[p] = np.minimum.reduceat(values, starts)
            high[p] = np.maximum.reduceat(values, starts)
        keys = np.empty((2 * PERMUTATIONS // BAND, len(sets)), np.uint64)
        for b in range(len(keys)):
            source, first = (low, BAND * b) if b < len(keys) // 2 else (high, BAND * (b - len(keys) // 2))
            key = np.full(len(sets), b + 1, np.uint64)
            for p in range(first, first + BAND):
                key = finish(key * _MULTIPLIER + source[p])
            keys[b] = key
    return keys.T.view(np.int64)
