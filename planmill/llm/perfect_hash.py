"""Minimal perfect hash over a set of 64-bit keys, with fingerprints; plain arrays."""

import numpy as np


def mix(x: np.ndarray, seed) -> np.ndarray:
    """Well-spread 64-bit values of (x, seed); a one-to-one map of x for a fixed seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _buckets(keys: np.ndarray, count: int) -> np.ndarray:
    return (mix(keys, 1 << 32) % np.uint64(count)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 33) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> np.ndarray:
    """Pilots: one number per bucket of keys. Keys must differ.

    Buckets take slots from the largest to the smallest: a bucket of several keys tries pilots
    until all its keys fall into free slots; a bucket of one key names its slot (negative).
    """
    n = len(keys)
    count = n // 3 + 1
    bucket = _buckets(keys, count)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=count)
    ends = np.cumsum(sizes)
    pilots = np.zeros(count, np.int64)
    free = np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = keys[order[ends[b] - sizes[b] : ends[b]]]
        base = 0
        while True:
            tries = np.arange(base, base + 64, dtype=np.uint64)
            slots = np.sort((mix(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64), axis=1)
            good = free[slots].all(axis=1) & (slots[:, 1:] != slots[:, :-1]).all(axis=1)
            if good.any():
                pick = int(good.argmax())
                pilots[b] = base + pick
                free[slots[pick]] = False
                break
            base += 64
    single = np.flatnonzero(sizes == 1)
    pilots[single] = -1 - np.flatnonzero(free)[: len(single)]
    return pilots


def slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """Slot 0..n-1 of each key; keys outside the set get some slot, so compare fingerprints."""
    pilot = pilots[_buckets(keys, len(pilots))]
    hashed = (mix(keys, np.maximum(pilot, 0).astype(np.uint64)) % np.uint64(max(n, 1))).astype(np.int64)
    return np.where(pilot < 0, -1 - pilot, hashed)
