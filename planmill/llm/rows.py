"""Row helpers shared by the text operators."""

from pyspark.sql import DataFrame, SparkSession

from planmill.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Materialise a table of narrow rows on the shared folder, read back in parts of about `rows`.

    The parts are neighbouring partitions read by one task each, so what follows starts as many tasks
    as the rows need and not as many as the step before had.
    """
    out = cut_lineage(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have yet, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def read_small_file(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary file of bounded size, read on the driver and sent with the task."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return data
