"""Deterministic uniform draws.

A draw depends only on (seed, variant, plan, operator, item), never on partitioning,
row order or task retries, so every randomised operator can be recomputed after an
executor loss and gives the same rows.
"""

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def u(op, item="''", seed=42, variant="variant", plan="plan_id"):
    """SQL text of a uniform draw in [0, 1)."""
    parts = ", ".join(
        f"cast({p} as string)" for p in (seed, variant, plan, f"'{op}'", item)
    )
    return f"(cast(conv(substr(md5(concat_ws('|', {parts})), 1, 8), 16, 10) as double) / 4294967296D)"


def randint(lo, hi, draw):
    """SQL text of an integer in [lo, hi] from a draw."""
    return f"cast({lo} + floor({draw} * ({hi} - {lo} + 1)) as int)"


def uniform(lo, hi, draw):
    """SQL text of a double in [lo, hi) from a draw."""
    return f"({lo} + ({hi} - {lo}) * {draw})"


def _head(seed, variant="variant", plan="plan_id"):
    """SQL text of what the texts of all draws of a row begin with."""
    return f"concat_ws('|', cast({seed} as string), cast({variant} as string), cast({plan} as string))"


def uniforms(texts) -> np.ndarray:
    """The draws of texts (bytes)."""
    return np.frombuffer(b"".join([md5(t).digest()[:4] for t in texts]), ">u4") / 4294967296.0


def drawn(op, items, seed=42) -> Column:
    """Array of the draws `u(op, item)` of a row, made in Arrow batches. `items` is a list of items or SQL text of a
    number n, which stands for 0 .. n - 1.

    The column counts as nondeterministic, so that the optimizer leaves it a column also where a lambda alone uses it.
    """
    counted = isinstance(items, str)

    def make(heads, *counts):
        heads = heads.cast(pa.binary()).to_pylist()
        if counted:
            n = np.maximum(counts[0].fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = [f"|{op}|{k}".encode() for k in range(n.max(initial=0))]
            values = uniforms(h + e for h, m in zip(heads, n.tolist(), strict=True) for e in ends[:m])
        else:
            n = np.full(len(heads), len(items))
            ends = [f"|{op}|{k}".encode() for k in items]
            values = uniforms(h + e for h in heads for e in ends)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, pa.float64()))

    run = F.arrow_udf(make, "array<double>").asNondeterministic()
    return run(F.expr(_head(seed)), *([F.expr(items)] if counted else []))


def gaussian_steps(rids, sizes, wanted, sigma, seed=42) -> Column:
    """For each of the lists of a row, of `sizes` numbers, rounded Gaussian steps; null where not `wanted`.

    The arguments are SQL text; the item of the i-th step of a list is `rid:i`.
    """
    def make(heads, rids, sizes):
        known = heads.is_valid().to_numpy(zero_copy_only=False)
        n = np.maximum(sizes.flatten().fill_null(0).to_numpy(zero_copy_only=False), 0)
        count = sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        owner = [h for h, m in zip(heads.cast(pa.binary()).to_pylist(), count.tolist(), strict=True) for _ in range(m)]
        own = rids.flatten().cast(pa.binary()).to_pylist()
        # A null item is left out of the text.
        texts = lambda op: (
            h + (b"|%b" % op if r is None else b"|%b|%b:%d" % (op, r, i))
            for h, r, m in zip(owner, own, n.tolist(), strict=True) for i in range(m))
        z = np.sqrt(-2.0 * np.log(1.0 - uniforms(texts(b"noise_r")))) * np.cos(2.0 * np.pi * uniforms(texts(b"noise_a")))
        ends = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]), pa.int32())
        steps = pa.ListArray.from_arrays(ends(n), pa.array(np.rint(z * sigma).astype(np.int32)))
        return pa.ListArray.from_arrays(ends(count), steps, mask=pa.array(~known))

    if_wanted = lambda c: F.expr(f"if({wanted}, {c}, null)")
    run = F.arrow_udf(make, "array<array<int>>").asNondeterministic()
    return run(if_wanted(_head(seed)), if_wanted(rids), if_wanted(sizes))
