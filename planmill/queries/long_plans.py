"""Queries over plans of any size: every order is a plan, however many items it has."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import ROOM_TYPES
from planmill.queries import sql as s
from planmill.queries.augmentation import digest_sql, digests, dump_sql
from planmill.queries.registry import query
from planmill.session import cut_lineage
from planmill.sources import long_plans as lp

#: The reference SQL over all orders, without the limit of room numbers.
ALL_ORDERS = {
    "item": """SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_quantity::INTEGER AS qty, l_linenumber AS ln,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS rid FROM lineitem"""
}

class LongPlans(NamedTuple):
    sizes: DataFrame
    rooms: DataFrame
    edges: DataFrame
    fronts: DataFrame
    relations: DataFrame


def long_plans(spark, sf) -> LongPlans:
    box_rows = lp.boxes(spark, sf)
    sizes = cut_lineage(lp.outlines(box_rows))
    rooms = lp.room_rows(box_rows, sizes)
    relations = lp.relation_rows(lp.centres(rooms), sizes)
    return LongPlans(sizes, rooms, lp.edge_rows(box_rows), lp.front_rows(spark, sf, sizes), relations)


_M = "cast(cast(rint({} * 1000) as bigint) as string)"
_DOOR = "concat_ws(',', " + ", ".join(_M.format("{d}." + k) for k in "xywh") + ")"


def texts(p: LongPlans, front=True) -> DataFrame:
    """(plan_id, kind, pos, val): every part of every plan as text."""
    row = lambda df, kind, val: df.select("plan_id", F.lit(kind).alias("kind"), "pos", F.expr(val).alias("val"))
    coords = "array_join(transform(coords, v -> cast(v as string)), ',')"
    out = row(p.rooms, "room", f"concat(cast(rid as string), ':', type, ':', {coords})")
    doors = f"array_join(transform(door, d -> {_DOOR.format(d='d')}), ';')"
    out = out.unionByName(row(p.edges, "edge", f"concat(cast(pair[0] as string), '-', cast(pair[1] as string), ':', {doors})"))
    if front:
        own = "concat_ws(',', " + ", ".join(_M.format(k) for k in "xywh") + ")"
        out = out.unionByName(row(p.fronts, "front", own))
    return out.unionByName(row(p.relations, "rel", "concat(cast(rid_a as string), '-', cast(rid_b as string), ':', direction)"))


@query("columnar_row_views", s.with_ctes(digest_sql(dump_sql("0", front=True)), ALL_ORDERS))
def columnar_row_views(spark, sf):
    """All parts of all plans from rows to columns and back."""
    p = long_plans(spark, sf)
    there = lambda df, *fields: lp.rows_of_chunks(lp.columnar_chunks(df, list(fields)))
    return digests(texts(LongPlans(
        p.sizes, there(p.rooms, "rid", "type", "coords"), there(p.edges, "pair", "door"),
        there(p.fronts, "x", "y", "w", "h"), there(p.relations, "rid_a", "rid_b", "direction"))))


@query("unify_rows", s.with_ctes(digest_sql(dump_sql("0")), ALL_ORDERS))
def unify_rows(spark, sf):
    """Raw rows, with `doors` and relations as lists of text, brought into one form."""
    p = long_plans(spark, sf)
    raw_edges = p.edges.withColumnRenamed("door", "doors")
    raw_relations = p.relations.select(
        "plan_id", "pos", F.array(F.col("rid_a").cast("string"), F.col("rid_b").cast("string"), "direction").alias("relation"))
    edges = lp.unify_edge_rows(lp.unify_edge_rows(raw_edges))
    relations = lp.unify_relation_rows(lp.unify_relation_rows(raw_relations))
    return digests(texts(p._replace(edges=edges, relations=relations), front=False))


@query("spatial_relations", s.with_ctes("SELECT plan_id, a::BIGINT AS rid_a, b::BIGINT AS rid_b, direction FROM rel0", ALL_ORDERS))
def spatial_relations(spark, sf):
    return long_plans(spark, sf).relations.select("plan_id", "rid_a", "rid_b", "direction")


@query("relation_counts", s.with_ctes(
    f"""SELECT t.type, direction, count(*) AS n FROM rel0 r JOIN (SELECT plan_id, rid, type FROM room0 WHERE type IN ({', '.join(repr(t) for t in ROOM_TYPES)})) t
        ON t.plan_id = r.plan_id AND t.rid = r.a GROUP BY ALL""", ALL_ORDERS))
def relation_counts(spark, sf):
    """How often a room type has another room in each direction."""
    p = long_plans(spark, sf)
    types = p.rooms.select("plan_id", F.col("rid").alias("rid_a"), "type")
    return p.relations.join(types, ["plan_id", "rid_a"]).groupBy("type", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("score_metadata", s.with_ctes(
    """SELECT plan_id, n::BIGINT AS total_rooms, string_agg(type || '=' || c, ',' ORDER BY type) AS type_counts, coalesce(ne, 0)::BIGINT AS n_edges, coalesce(ns, 0)::BIGINT AS n_spatial
        FROM (SELECT plan_id, type, count(*) AS c FROM box GROUP BY ALL) JOIN outl USING (plan_id)
        LEFT JOIN (SELECT plan_id, count(*) AS ne FROM edge0 GROUP BY 1) USING (plan_id) LEFT JOIN (SELECT plan_id, count(*) AS ns FROM rel0 GROUP BY 1) USING (plan_id) GROUP BY ALL""", ALL_ORDERS))
def score_metadata(spark, sf):
    p = long_plans(spark, sf)
    return lp.metadata_rows(p.rooms, p.edges, p.relations).select(
        "plan_id", "total_rooms", F.expr("array_join(transform(map_entries(type_counts), e -> concat(e.key, '=', cast(e.value as string))), ',')").alias("type_counts"),
        "n_edges", "n_spatial")
