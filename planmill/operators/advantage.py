"""Scores -> group-normalised, token-level advantages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import ADVANTAGE_EPS
from planmill.operators.score import REWARDS, RewardConfig


def group_normalize(df: DataFrame, names=None, group="prompt_id", eps=ADVANTAGE_EPS) -> DataFrame:
    """`a_<name>`: z-score of each score within its prompt's group of completions.

    Population deviation over the whole group, a NaN score counting as no deviation. Statistics
    are partial aggregates joined back, so no group is ever gathered in one task.
    """
    names = names or [n for n in REWARDS if f"r_{n}" in df.columns]
    clean = {n: F.expr(f"if(isnan(r_{n}), null, r_{n})") for n in names}
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(clean[n]).alias(f"_m_{n}") for n in names],
        *[(F.var_pop(clean[n]) * F.count(clean[n])).alias(f"_q_{n}") for n in names],
    )
    joined = df.join(stats, group)
    scaled = {
        f"a_{n}": F.expr(
            f"coalesce(nanvl((r_{n} - _m_{n}) / (sqrt(_q_{n} / _n) + {eps}D), 0D), 0D)"
        )
        for n in names
    }
    return joined.withColumns(scaled).drop("_n", *[f"_m_{n}" for n in names], *[f"_q_{n}" for n in names])


def credit(advantage: str, mask: str, penalty: float) -> str:
    """SQL text: A where the token is fine, -|A| * penalty where it is marked."""
    return f"transform({mask}, m -> {advantage} * (1D - m) - abs({advantage}) * {penalty}D * m)"


def token_advantages(df: DataFrame, length: str = "size(tokens)", cfg: RewardConfig = RewardConfig()) -> DataFrame:
    """`token_adv`: weighted sum over scores at token level; marks only where a score gives credit."""
    used = [n for n in REWARDS if n in cfg.rewards and cfg.rewards[n].enabled and f"a_{n}" in df.columns]
    base = " + ".join(f"{cfg.rewards[n].weight}D * a_{n}" for n in used) or "0D"
    # A marked token gets -|A| * penalty in place of A: a correction to the sequence's own value.
    marked = [n for n in used if cfg.rewards[n].credit and f"e_{n}" in df.columns]
    changes = "".join(
        f" + if(array_contains(e_{n}, i), {cfg.rewards[n].weight}D * (-abs(a_{n}) * {cfg.rewards[n].penalty}D - a_{n}), 0D)"
        for n in marked
    )
    df = df.withColumn("_base", F.expr(base))
    total = f"array_repeat(_base, {length})"
    if marked:
        none = " and ".join(f"size(e_{n}) = 0" for n in marked)
        total = f"if({none} or {length} = 0, {total}, transform(sequence(0, {length} - 1), i -> _base{changes}))"
    return df.withColumn("token_adv", F.expr(total)).drop("_base")


def batch_normalize(df: DataFrame, batch="batch_id", eps=ADVANTAGE_EPS, pad=False) -> DataFrame:
    """Shift and scale `token_adv` by the batch's mean and sample deviation of sequence means.

    With `pad`, rows are first filled with zeros up to the batch's longest sequence, and the
    filling is shifted as well.
    """
    mean = "if(size(token_adv) = 0, 0D, aggregate(token_adv, 0D, (s, v) -> s + v) / size(token_adv))"
    held = df.withColumn("_seq", F.expr(mean))
    stats = held.groupBy(batch).agg(
        F.avg("_seq").alias("_bm"),
        F.coalesce(F.stddev_samp("_seq"), F.lit(0.0)).alias("_bs"),
        F.max(F.size("token_adv")).alias("_len"),
    )
    values = "concat(token_adv, array_repeat(0D, _len - size(token_adv)))" if pad else "token_adv"
    return (
        held.join(stats, batch)
        .withColumn("token_adv", F.expr(f"transform({values}, v -> (v - _bm) / (_bs + {eps}D))"))
        .drop("_seq", "_bm", "_bs", "_len")
    )
