"""Floor plans derived from the order / line-item tables.

Every order is a plan and every line item a room, so all plan operators can run over whole
tables. The result has the canonical nested columns.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmill.constants import MAX_RID, OUTLINE, ROOM_TYPES
from planmill.functions import geometry as g
from planmill.operators.skew import split_by_group_size

_TYPES = "array(" + ", ".join(f"'{t}'" for t in ROOM_TYPES) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )


def room_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per plan: (plan_id, boxes array<struct<rid, pk, type, x0, y0, x1, y1, ell>>).

    A plan can number at most 15 rooms, so orders with more items are not plans: they are
    reported by `oversized_plans` and never gathered.
    """
    kept, _ = split_by_group_size(_items(spark, sf_dir), "l_orderkey", MAX_RID)
    # The plan columns are an order of magnitude larger than the items they come from, so the
    # number of partitions is fixed here instead of being coalesced by the size of the input.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = kept.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(
        F.array_sort(
            F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
        ).alias("items")
    )
    return grouped.select(
        F.col("l_orderkey").cast("string").alias("plan_id"),
        F.col("l_orderkey").alias("order_key"),
        F.expr(
            f"""transform(transform(items, (s, i) -> named_struct(
                'rid', i + 1, 'pk', s.l_partkey,
                'type', {_TYPES}[cast(s.l_partkey % 8 as int)],
                'x0', cast(48 * (i % 4) + s.l_partkey % 16 as int),
                'y0', cast(48 * (i div 4) + s.l_suppkey % 16 as int),
                'w', cast(24 + cast(s.l_quantity as int) % 40 as int),
                'h', cast(24 + (s.l_partkey + s.l_suppkey) % 40 as int),
                'ell', s.l_linenumber % 2 = 0)),
              b -> named_struct('rid', b.rid, 'pk', b.pk, 'type', b.type, 'x0', b.x0, 'y0', b.y0,
                'x1', b.x0 + b.w, 'y1', b.y0 + b.h,
                'xm', b.x0 + cast(b.w div 2 as int), 'ym', b.y0 + cast(b.h div 2 as int), 'ell', b.ell))"""
        ).alias("boxes"),
    )


def plan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of every order, also of those without items or with too many."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("plan_id"))


def plan_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, n_rooms) of every order with items; a partial count, so no order is gathered."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rooms")).select(
        F.col("l_orderkey").cast("string").alias("plan_id"), "n_rooms"
    )


def oversized_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that cannot be numbered as plans, with a reason code."""
    _, oversized = split_by_group_size(_items(spark, sf_dir), "l_orderkey", MAX_RID)
    return oversized.select(
        F.col("l_orderkey").cast("string").alias("plan_id"),
        F.lit("too_many_rooms").alias("reason"),
        F.col("n_rows").alias("n_rooms"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical nested plans."""
    boxes = room_boxes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_custkey", "o_orderstatus"
    )
    shaped = boxes.join(orders, "order_key", "left").select(
        "plan_id",
        "boxes",
        "o_custkey",
        "o_orderstatus",
        F.expr(
            "named_struct('x0', array_min(transform(boxes, b -> b.x0)), 'y0', array_min(transform(boxes, b -> b.y0)),"
            " 'x1', array_max(transform(boxes, b -> b.x1)), 'y1', array_max(transform(boxes, b -> b.y1)))"
        ).alias("o"),
    )
    ring = "array({p}.x0, {p}.y0, {p}.x0, {p}.y1, {p}.x1, {p}.y1, {p}.x1, {p}.y0)"
    ell = "array(b.x0, b.y0, b.x0, b.y1, b.x1, b.y1, b.x1, b.ym, b.xm, b.ym, b.xm, b.y0)"
    shaped = shaped.select(
        "plan_id",
        F.expr(
            f"concat(array(named_struct('rid', 0, 'type', '{OUTLINE}', 'coords', {ring.format(p='o')})),"
            f" transform(boxes, b -> named_struct('rid', b.rid, 'type', b.type,"
            f" 'coords', if(b.ell, {ell}, {ring.format(p='b')}))))"
        ).alias("rooms"),
        F.expr(
            """flatten(transform(boxes, a -> transform(
                filter(boxes, b -> (b.rid = a.rid + 1 and a.rid % 4 <> 0) or b.rid = a.rid + 4),
                b -> named_struct('pair', array(a.rid, b.rid), 'door', if((a.pk + b.pk) % 3 <> 0,
                  array(named_struct(
                    'x', cast((a.x0 + a.x1 + b.x0 + b.x1) / 4D as float),
                    'y', cast((a.y0 + a.y1 + b.y0 + b.y1) / 4D as float),
                    'w', cast(2 + a.pk % 6 as float), 'h', cast(2 + b.pk % 6 as float))),
                  cast(array() as array<struct<x:float,y:float,w:float,h:float>>))))))"""
        ).alias("edges"),
        F.expr(
            """if(coalesce(o_orderstatus, 'P') = 'P', cast(array() as array<struct<x:float,y:float,w:float,h:float>>),
                array(named_struct('x', cast(o.x0 + o_custkey % (o.x1 - o.x0 + 1) as float),
                  'y', cast(o.y0 as float), 'w', cast(8 as float), 'h', cast(2 as float))))"""
        ).alias("front_door"),
    )
    return relate_rooms(shaped)


def relate_rooms(df: DataFrame) -> DataFrame:
    """Add `spatial`: the direction from every room to every later one (outline left out)."""
    centred = df.withColumn(
        "_c",
        F.expr(
            f"transform(filter(rooms, r -> r.type <> '{OUTLINE}'), r -> named_struct('rid', r.rid,"
            f" 'cx', {g.mean(g.xs('r.coords'))}, 'cy', {g.mean(g.ys('r.coords'))}))"
        ),
    )
    return centred.withColumn("spatial", F.expr(relations_of("_c"))).drop("_c")


def relations_of(centres: str) -> str:
    """SQL text: all relations among an array of (rid, cx, cy) structs, ordered by the two rids."""
    direction = g.direction_built("(b.cx - a.cx)", "(b.cy - a.cy)")
    return (
        f"array_sort(flatten(transform({centres}, a -> transform(filter({centres}, b -> b.rid > a.rid),"
        f" b -> named_struct('rid_a', a.rid, 'rid_b', b.rid, 'direction', {direction})))))"
    )
