"""Row filters on derived columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_rows(df: DataFrame, condition: str) -> DataFrame:
    """Filter by a derived column without having its expression copied into the scan filter.

    A plain filter on a column that is computed in several steps is pushed below them, which
    repeats the steps once per use; a generator's output cannot be pushed.
    """
    flag = F.explode_outer(F.expr(f"if({condition}, array(true), array(cast(null as boolean)))"))
    return df.select("*", flag.alias("_keep")).filter("_keep").drop("_keep")
