"""Gapless numbers over sorted rows, without a window over a whole group."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmill.session import cut_lineage


def _changes(columns, before) -> np.ndarray:
    """Whether each row differs from the one before it in some column; nulls are equal to each other."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    for column, last in zip(columns, before, strict=True):
        out[0] |= column[0].as_py() != last
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] |= differ | nulls
    return out


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Adds `name`: 1, 2, .. within the rows of equal keys, in the given order; ties in any order.

    Without keys the whole table is numbered. Rows are range-partitioned by keys and order, so the rows of
    a hot key lie in many neighbouring tasks, and each task counts its rows as they pass. Only the
    first group of a task can go on from the task before; the rows that lie ahead of it come from one row a
    task. The sorted rows are written once to the shared folder, as two jobs read them: project before.
    """
    taken = {c.lower() for c in df.columns}
    clash = taken & {"_part", "_group", "_at", "_ahead", name.lower()}
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    columns, places = df.columns, [df.columns.index(k) for k in keys]

    def count(batches):
        before, group, at = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = [batch.column(i) for i in places]
            if before is None:
                before = [c[0].as_py() for c in own]
            opens = _changes(own, before) if own else np.zeros(n, bool)
            groups = group + np.cumsum(opens)
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(opens, row, -1))
            numbers = np.where(start < 0, at + row, row - start)
            before, group, at = [c[n - 1].as_py() for c in own], int(groups[-1]), int(numbers[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups), pa.array(numbers)], [*columns, "_group", "_at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    ordered = df.orderBy(*keys, *order) if keys or order else df
    counted = ordered.mapInArrow(count, f"{fields}, _group bigint, _at bigint").withColumn("_part", F.spark_partition_id())
    counted = cut_lineage(counted)
    entry = lambda *first: F.struct(*first, *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    edges = counted.groupBy("_part").agg(
        F.max(entry("_group", "_at")).alias("last"), F.max(F.when(F.col("_group") == 0, entry("_group", "_at"))).alias("first")
    )
    edges = edges.select("_part", F.explode(F.expr("if(last._group = 0, array(last), array(first, last))")).alias("e"))
    held = [f"_k{i}" for i in range(len(keys))]
    edges = edges.select("_part", "e._group", (F.col("e._at") + 1).alias("n"), *[F.col(f"e.{k}") for k in held])
    ahead = Window.partitionBy(*held).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = edges.withColumn("_ahead", F.sum("n").over(ahead)).filter("_group = 0 and _ahead > 0").select("_part", "_group", "_ahead")
    # At most one row for each task of the sort.
    out = counted.join(F.broadcast(offsets), ["_part", "_group"], "left")
    return out.select(*columns, (F.col("_at") + 1 + F.coalesce("_ahead", F.lit(0))).alias(name))
