"""Plans of any size as long tables: one row for each room, edge, door and relation.

A nested plan holds at most 15 rooms, because room numbers end there. Where no room number has to be
written, plans of any size stand in these tables; no step gathers a plan. Room rows are numbered over
sorted tasks, neighbours meet by an equality join on (plan, room), and relations by a join of blocks of
at most BLOCK rooms, so that a task's group never holds more than BLOCK x BLOCK pairs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmill.constants import OUTLINE
from planmill.functions import geometry as g
from planmill.operators.numbering import number_rows
from planmill.operators.skew import spread_join
from planmill.sources.tables import _TYPES, table

BLOCK = 64
CHUNK = 1024


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, order_key, rid, pk, type, x0, y0, x1, y1, xm, ym, ell) of every line item."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    numbered = number_rows(items, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "rid")
    cell = numbered.select(
        F.col("l_orderkey").cast("string").alias("plan_id"), F.col("l_orderkey").alias("order_key"), "rid",
        F.col("l_partkey").alias("pk"), F.expr(f"{_TYPES}[cast(l_partkey % 8 as int)]").alias("type"),
        F.expr("48 * ((rid - 1) % 4) + l_partkey % 16").alias("x0"), F.expr("48 * ((rid - 1) div 4) + l_suppkey % 16").alias("y0"),
        F.expr("24 + cast(l_quantity as int) % 40").alias("w"), F.expr("24 + (l_partkey + l_suppkey) % 40").alias("h"),
        F.expr("l_linenumber % 2 = 0").alias("ell"),
    )
    return cell.select(
        "plan_id", "order_key", "rid", "pk", "type", "x0", "y0", F.expr("x0 + w").alias("x1"), F.expr("y0 + h").alias("y1"),
        F.expr("x0 + w div 2").alias("xm"), F.expr("y0 + h div 2").alias("ym"), "ell",
    )


def outlines(box_rows: DataFrame) -> DataFrame:
    """(plan_id, order_key, x0, y0, x1, y1, n): extent and size of each plan, by partial aggregates."""
    return box_rows.groupBy("plan_id", "order_key").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")
    )


def room_rows(box_rows: DataFrame, outline_rows: DataFrame) -> DataFrame:
    """(plan_id, pos, rid, type, coords): the outline at place 0, then the rooms."""
    ring = "array(x0, y0, x0, y1, x1, y1, x1, y0)"
    ell = "array(x0, y0, x0, y1, x1, y1, x1, ym, xm, ym, xm, y0)"
    first = outline_rows.select(
        "plan_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("rid"), F.lit(OUTLINE).alias("type"),
        F.expr(ring).alias("coords"),
    )
    rest = box_rows.select("plan_id", F.col("rid").alias("pos"), "rid", "type", F.expr(f"if(ell, {ell}, {ring})").alias("coords"))
    return first.unionByName(rest)


def edge_rows(box_rows: DataFrame) -> DataFrame:
    """(plan_id, pos, pair, door): neighbours on the grid; a room has at most two of higher number."""
    ends = box_rows.select("plan_id", "order_key", "rid", "pk", "x0", "x1", "y0", "y1")
    left = ends.withColumn(
        "other", F.explode(F.expr("if(rid % 4 <> 0, array(rid + 1, rid + 4), array(rid + 4))"))
    ).alias("a")
    right = ends.alias("b")
    met = left.join(right, (F.col("a.order_key") == F.col("b.order_key")) & (F.col("a.other") == F.col("b.rid")))
    door = (
        "if((a.pk + b.pk) % 3 <> 0, array(named_struct('x', cast((a.x0 + a.x1 + b.x0 + b.x1) / 4D as double),"
        " 'y', cast((a.y0 + a.y1 + b.y0 + b.y1) / 4D as double), 'w', cast(2 + a.pk % 6 as double), 'h', cast(2 + b.pk % 6 as double))),"
        " cast(array() as array<struct<x:double,y:double,w:double,h:double>>))"
    )
    pairs = met.select("a.plan_id", F.col("a.rid").alias("a"), F.col("b.rid").alias("b"), F.expr(door).alias("door"))
    return number_rows(pairs, ["plan_id"], ["a", "b"], "pos").select(
        "plan_id", (F.col("pos") - 1).alias("pos"), F.array("a", "b").alias("pair"), "door"
    )


def front_rows(spark: SparkSession, sf_dir: str, outline_rows: DataFrame) -> DataFrame:
    """(plan_id, pos, x, y, w, h) of the front doors."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), "o_custkey", "o_orderstatus")
    return outline_rows.join(orders.filter("o_orderstatus <> 'P'"), "order_key").select(
        "plan_id", F.lit(0).cast("long").alias("pos"), F.expr("cast(x0 + o_custkey % (x1 - x0 + 1) as double)").alias("x"),
        F.col("y0").cast("double").alias("y"), F.lit(8.0).alias("w"), F.lit(2.0).alias("h"),
    )


def relation_rows(rooms: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(plan_id, pos, rid_a, rid_b, direction) from every room to every later one.

    `rooms`: (plan_id, rid from 1, cx, cy); `sizes`: (plan_id, n). There are n (n - 1) / 2 relations in a
    plan, which is the result asked for; they are made in cells of two blocks of rooms each.
    """
    at = spread_join(rooms, sizes.select("plan_id", "n"), "plan_id").withColumns(
        {"_block": F.expr(f"(rid - 1) div {block}"), "_last": F.expr(f"(n - 1) div {block}")}
    )
    keep = ["plan_id", "rid", "cx", "cy"]
    left = at.select(*keep, "n", F.col("_block").alias("_i"), F.explode(F.expr("sequence(_block, _last)")).alias("_j")).alias("a")
    right = at.select(*keep, F.explode(F.expr("sequence(0L, _block)")).alias("_i"), F.col("_block").alias("_j")).alias("b")
    cell = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("plan_id", "_i", "_j")]
    met = left.join(right, [*cell, F.col("a.rid") < F.col("b.rid")])
    pos = "(a.rid - 1) * a.n - a.rid * (a.rid - 1) div 2 + b.rid - a.rid - 1"
    return met.select(
        "a.plan_id", F.expr(pos).alias("pos"), F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"),
        F.expr(g.direction_built("(b.cx - a.cx)", "(b.cy - a.cy)")).alias("direction"),
    )


def centres(rooms: DataFrame) -> DataFrame:
    """(plan_id, rid, cx, cy): means of the vertices of the rooms, outline left out."""
    return rooms.filter(F.col("type") != OUTLINE).select(
        "plan_id", "rid", F.expr(g.mean(g.xs("coords"))).alias("cx"), F.expr(g.mean(g.ys("coords"))).alias("cy")
    )


def metadata_rows(rooms: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(plan_id, total_rooms, type_counts, n_edges, n_spatial) from the long tables, by partial aggregates."""
    inner = rooms.filter(F.col("type") != OUTLINE)
    by_type = inner.groupBy("plan_id", "type").agg(F.count(F.lit(1)).alias("c"))
    counts = by_type.groupBy("plan_id").agg(
        F.sum("c").alias("total_rooms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "c")))).alias("type_counts")
    )
    sized = lambda df, name: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(name))
    joined = counts.join(sized(edges, "n_edges"), "plan_id", "left").join(sized(relations, "n_spatial"), "plan_id", "left")
    return joined.fillna(0, ["n_edges", "n_spatial"])


# --- row and columnar views -------------------------------------------------------------------


def columnar_chunks(rows: DataFrame, fields: list[str], chunk: int = CHUNK) -> DataFrame:
    """(plan_id, chunk, items struct of arrays): long rows as columns, at most `chunk` places in one row."""
    grouped = rows.groupBy("plan_id", F.expr(f"pos div {chunk}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("v")))).alias("_z")
    )
    return grouped.select(
        "plan_id", "chunk", F.struct(F.expr("transform(_z, z -> z.pos)").alias("pos"), *[
            F.expr(f"transform(_z, z -> z.v.{f})").alias(f) for f in fields]).alias("items"))


def rows_of_chunks(chunks: DataFrame) -> DataFrame:
    """The long rows of columnar chunks (the inverse of `columnar_chunks`)."""
    fields = [f.name for f in chunks.schema["items"].dataType]
    zipped = F.arrays_zip(*[F.col(f"items.{f}") for f in fields])
    return chunks.select("plan_id", F.explode(zipped).alias("z")).select("plan_id", *[F.col(f"z.{f}") for f in fields])


def unify_edge_rows(edges: DataFrame) -> DataFrame:
    """Raw edge rows, which hold `doors`, `door` or both, with one `door` column; idempotent."""
    if "doors" not in edges.columns:
        return edges
    door = F.coalesce("door", "doors") if "door" in edges.columns else F.col("doors")
    return edges.withColumn("door", door).drop("doors")


def unify_relation_rows(relations: DataFrame) -> DataFrame:
    """Raw relation rows, a list (rid_a, rid_b, direction) of text, with three columns; idempotent."""
    if "relation" not in relations.columns:
        return relations
    return relations.withColumns(
        {"rid_a": F.expr("cast(relation[0] as bigint)"), "rid_b": F.expr("cast(relation[1] as bigint)"), "direction": F.expr("relation[2]")}
    ).drop("relation")
