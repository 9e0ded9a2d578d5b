"""Columnar datasets partitioned by split."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").parquet(folder)


def read_split(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """One split (partition-pruned), or the whole set when it has no splits or none is asked for."""
    df = spark.read.parquet(folder)
    if split is None or "split" not in df.columns:
        return df
    part = df.filter(F.col("split") == split)
    if part.isEmpty():
        found = [r["split"] for r in df.select("split").distinct().orderBy("split").collect()]
        raise KeyError(f"no split {split!r}; available: {found}")
    return part
