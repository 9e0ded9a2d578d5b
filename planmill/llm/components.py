"""Connected components of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.llm.rows import settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _step(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node `a` hands its smallest neighbour to its larger (large) or smaller neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    kept = pairs.join(least, "a").filter(F.col("b") > F.col("a") if large else F.col("b") < F.col("a"))
    out = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(kept.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one edge to its root, and no root has an edge of its own."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        edges.select(F.col("b").alias("x"), F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
    return nodes.filter("out > 1 or (out = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of `edges` (a, b).

    A step is a join of edges with partial minima, so a hub of any degree is only one row of the
    smaller side. Each step is written to the shared folder; rounds grow with the logarithm of the
    longest chain. An edge from a node to itself adds no node; an empty table gives no rows.
    """
    current = settle(edges.select("a", "b").filter(F.col("a") != F.col("b")))
    while True:
        wide = settle(_step(_both(current), True))
        current = settle(_step(_both(wide), False))
        if _is_star(current):
            break
    star = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return star.union(star.select(F.col("root").alias("node"), "root")).distinct()
