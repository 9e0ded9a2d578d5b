"""Operator 10, sharding: jump consistent hashing and gapless slots, DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planmill.llm.rows import fresh
from planmill.session import cut_lineage


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a key by jump consistent hashing.

    The key seeds a row of draws. A key at bucket b jumps to floor((b + 1) / u), u being its next
    draw from (0, 1], until it would leave the shards; it stays in the last bucket within. As the
    draws do not depend on the number of shards, one more shard takes keys only into itself, each
    with probability 1 / (shards + 1). A jump goes at least one bucket on, so `shards` draws are
    enough. Null keys share one row of draws.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    draw = lambda i: F.shiftrightunsigned(F.xxhash64(key, i), 33) + 1  # noqa: E731  1 .. 2^31
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def step(acc, i):
        jump = F.floor((acc["to"] + 1) * F.lit(2147483648.0) / draw(i)).cast("long")
        return F.when(
            acc["to"] < shards, F.struct(acc["to"].alias("at"), jump.alias("to"))
        ).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, start, step, lambda acc: acc["at"].cast("int"))


def with_slots(df: DataFrame, shard: str) -> DataFrame:
    """Adds `slot`: gapless numbers from 0 within each shard, all columns kept.

    Rows are numbered within (shard, input partition), so no group is larger than an input
    partition, whatever one key or shard holds; the sums of earlier partitions come on top. Both
    passes read one materialised copy of the rows: project before calling this.
    """
    part, row, here, before = fresh(df, "_part", "_row", "_here", "_before")
    fixed = cut_lineage(
        df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()})
    )
    ranked = fixed.withColumn(
        here, F.row_number().over(Window.partitionBy(shard, part).orderBy(row)) - 1
    )
    earlier = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        fixed.groupBy(shard, part)
        .agg(F.count(F.lit(1)).alias(here))
        .select(shard, part, F.coalesce(F.sum(here).over(earlier), F.lit(0)).alias(before))
    )
    joined = ranked.join(counts, [shard, part])
    return joined.select(*df.columns, (F.col(before) + F.col(here)).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard, slot and the shard with one more shard for every document.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ("key": doc_id and the
    number of shards decide), shard, slot, grown_shard. Null or empty text: size 1, crc32 0. Rows
    that share a doc_id share a shard and have slots of their own; a null doc_id is a key like any
    other. An empty table gives no rows. Other columns of the input are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    out = with_slots(rows, "shard")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
