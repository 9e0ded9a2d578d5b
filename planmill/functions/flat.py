"""Lists of a batch as flat arrays."""

import numpy as np
import pyarrow as pa


def ranges(first, count):
    """All of first .. first + count - 1, range by range, and the number of the range of each."""
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner], owner


def offsets(owner, n):
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())


def crossed(first_a, count_a, first_b, count_b):
    """All pairs of a place in range k of a and one in range k of b: (places, places, k)."""
    a, owner = ranges(first_a, count_a)
    b, of = ranges(first_b[owner], count_b[owner])
    return a[of], b, owner[of]


def lists_of(lists: pa.Array):
    """(start, length) of each list within the flattened values; a null list is empty."""
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(length) - length, length


def distinct(owner, values):
    """Different (owner, value) pairs of numbers from 0, in order."""
    step = int(values.max(initial=0)) + 1
    return np.divmod(np.unique(owner * step + values), step)


def ring_means(rings: pa.Array, shift=None):
    """(mean x, mean y, whether it has both) of flat coordinate lists; a mean over a null or over nothing is -inf.

    `shift` is added to the x values of each list.
    """
    _, size = lists_of(rings)
    numbers = rings.flatten()
    values = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    hole = ~numbers.is_valid().to_numpy(zero_copy_only=False)
    at, owner = ranges(np.zeros(len(size), np.int64), size)
    means = []
    for odd in (0, 1):
        mine = at % 2 == odd
        count = np.bincount(owner[mine], minlength=len(size))
        whole = (count > 0) & (np.bincount(owner[mine & hole], minlength=len(size)) == 0)
        total = group_sums(np.where(mine, values, 0), size)
        if shift is not None and not odd:
            total = total + shift * count
        means.append(np.where(whole, total / np.maximum(count, 1), -np.inf))
    return *means, np.isfinite(means[0]) & np.isfinite(means[1])


def group_sums(values, size):
    """Exact sums of integers that lie group by group."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(size)
    return total[end] - total[end - size]


def first_places(keys, wanted):
    """Place of the first of `keys` that equals each wanted one, -1 where none does."""
    if not len(keys):
        return np.full(len(wanted), -1)
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order[at]] == wanted, order[at], -1)
