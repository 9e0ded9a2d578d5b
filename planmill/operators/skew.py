"""Guards against hot keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_group_size(rows: DataFrame, key: str, limit: int, buckets: int = 32):
    """Separate groups of at most `limit` rows from larger ones without gathering any group.

    The sizes come from a partial count, so a key that holds a third of all rows sends one
    small row per input partition. The anti join spreads the rows of a hot key over `buckets`
    tasks; only keys over the limit are repeated per bucket. Returns (kept rows, sizes of the
    groups over the limit).
    """
    oversized = (
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > limit)
    )
    spread = oversized.select(key, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"))
    kept = (
        rows.withColumn("_bucket", (F.monotonically_increasing_id() % buckets).cast("int"))
        .join(spread, [key, "_bucket"], "left_anti")
        .drop("_bucket")
    )
    return kept, oversized


def spread_join(rows: DataFrame, sizes: DataFrame, key: str, size: str = "n", per_task: int = 100_000, salts: int = 64) -> DataFrame:
    """`rows` with the columns of `sizes`, which has one row a key with the number `size` of its rows.

    A key with more than `per_task` rows is repeated in `sizes` for each of `salts` salts, and its rows
    draw one, so a hot key's rows are spread over tasks; other keys have the one salt 0. Which keys are hot is
    told to the rows by a broadcast of at most `total rows / per_task` keys, made only while that list is short.
    """
    hot = sizes.filter(F.col(size) > per_task).select(key, F.lit(True).alias("_hot"))
    if hot.limit(_SHORT + 1).count() > _SHORT:
        # Then no key holds more than a small part of the rows, and the join may go by the key alone.
        return rows.join(sizes, key)
    marked = rows.join(F.broadcast(hot), key, "left")
    salted = marked.withColumn("_salt", F.expr(f"if(_hot, cast(monotonically_increasing_id() % {salts} as int), 0)")).drop("_hot")
    spread = sizes.withColumn(
        "_salt", F.explode(F.expr(f"if({size} > {per_task}, sequence(0, {salts - 1}), array(0))"))
    )
    return salted.join(spread, [key, "_salt"]).drop("_salt")


_SHORT = 10_000
