"""Operator 5, line dedup: windows of three consecutive lines, later occurrences removed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.llm.rows import fresh

WIDTH = 3


def _windows(rows: DataFrame) -> DataFrame:
    """(id, content, pos, h1, h2) for every window of three lines that has some text."""
    return rows.filter(F.size("lines") >= WIDTH).select(
        "id",
        "content",
        F.inline(
            F.expr(
                r"""filter(transform(sequence(0, size(lines) - 3), i -> named_struct(
                     'pos', i,
                     'h1', xxhash64(lines[i], lines[i + 1], lines[i + 2]),
                     'h2', xxhash64(7, lines[i + 2], lines[i + 1], lines[i]),
                     'blank', trim(lines[i]) = '' and trim(lines[i + 1]) = '' and trim(lines[i + 2]) = '')),
                   w -> not w.blank)"""
            )
        ),
    ).drop("blank")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, content, starts): where windows start that occur earlier in (id, content, pos) order.

    `rows` has (id, content, lines). The first occurrence is a partial minimum, so copies of a
    frequent window meet as one row per task; the join back may be split by AQE.
    """
    windows = _windows(rows)
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(
            F.min(F.struct("id", "content", "pos")).alias("first"),
            F.max(F.struct("id", "content", "pos")).alias("last"),
        )
        .filter(~F.col("first").eqNullSafe(F.col("last")))
        .select("h1", "h2", "first")
    )
    later = windows.join(firsts, ["h1", "h2"]).filter(
        ~F.struct("id", "content", "pos").eqNullSafe(F.col("first"))
    )
    return later.groupBy("id", "content").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines of repeated three-line windows; all columns of `docs` are kept.

    A window is three consecutive lines (text between line feeds) that are not all blank. Windows
    are counted over the whole table; each but the first in (doc_id, text hash, position) order is
    covered, and covered lines go, overlaps merged. Adds n_lines, n_removed and n_spans (maximal
    removed runs) to the columns; a column of `docs` with one of these names gives way.

    Null text stays null with 0 lines; an empty text is one empty line; texts of fewer than three
    lines stay whole. Rows that share doc_id and text count as one row and have the same result.
    A null doc_id comes before all others. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "n_spans")
    content, starts = fresh(docs, "_content", "_starts")
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("doc_id", "text").alias("content"),
        F.split("text", "\n").alias("lines"),
    ).filter(F.col("lines").isNotNull())
    found = repeated_windows(rows).select(
        F.col("id").alias(content + "i"), F.col("content").alias(content + "c"), F.col("starts").alias(starts)
    )
    joined = docs.withColumn(content, F.xxhash64("doc_id", "text")).join(
        found,
        F.col("doc_id").eqNullSafe(F.col(content + "i")) & (F.col(content) == F.col(content + "c")),
        "left",
    )
    lines, covered = fresh(joined, "_lines", "_covered")
    kept = joined.withColumns(
        {
            lines: F.split("text", "\n"),
            covered: F.expr(
                f"coalesce(array_distinct(flatten(transform(`{starts}`, p -> array(p, p + 1, p + 2)))), array())"
            ),
        }
    )
    left = f"array_except(sequence(0, size(`{lines}`) - 1), `{covered}`)"
    return kept.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        F.expr(
            f"case when size(`{covered}`) = 0 then text else"
            f" array_join(transform({left}, i -> `{lines}`[i]), '\n') end"
        ).alias("text"),
        F.expr(f"if(text is null, 0L, cast(size(`{lines}`) as bigint))").alias("n_lines"),
        F.expr(f"cast(size(`{covered}`) as bigint)").alias("n_removed"),
        F.expr(f"cast(size(array_except(`{covered}`, transform(`{covered}`, c -> c + 1))) as bigint)").alias(
            "n_spans"
        ),
    )
