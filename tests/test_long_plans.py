"""Plans of any size, and gapless numbers over many tasks."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from planmill.functions import geometry as g
from planmill.operators.numbering import number_rows
from planmill.operators import skew
from planmill.queries import long_plans as q
from planmill.queries.catalog import QUERIES
from planmill.sources import long_plans as lp
from planmill.sources import tables

SF = "/root/testdata/sf0.001"
HOT = 900


@pytest.fixture
def uncoalesced(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, before)


@pytest.mark.parametrize("keys", [["k"], ["k", "m"], []])
def test_numbers(uncoalesced, keys):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice([1, None]), rng.randrange(10**6)) for _ in range(3000)]
    df = uncoalesced.createDataFrame(rows, "k string, m int, v long").repartition(5)
    got = number_rows(df, keys, ["v"], "no").collect()
    groups = {}
    for r in got:
        groups.setdefault(tuple(r[k] for k in keys), []).append((r["no"], r["v"]))
    assert sum(map(len, groups.values())) == len(rows)
    for own in groups.values():
        own.sort()
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        assert [v for _, v in own] == sorted(v for _, v in own)


def test_numbers_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert number_rows(empty, ["k"], ["v"]).collect() == number_rows(empty, [], ["v"]).collect() == []
    with pytest.raises(ValueError, match="in the way"):
        number_rows(empty.withColumn("_at", F.lit(1)), ["k"], ["v"])


@pytest.mark.parametrize("short", [10_000, 0])
def test_spread_join(spark, monkeypatch, short):
    monkeypatch.setattr(skew, "_SHORT", short)
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [("b", 1), ("c", 2)], "plan_id string, i int")
    sizes = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))
    got = skew.spread_join(rows, sizes, "plan_id", per_task=100, salts=7)
    assert got.columns == ["plan_id", "i", "n"]
    assert sorted(map(tuple, got.collect())) == sorted([("hot", i, 500) for i in range(500)] + [("b", 1, 1), ("c", 2, 1)])


@pytest.fixture(scope="module")
def hot_folder(spark, tmp_path_factory):
    """The small tables with one order of HOT items more."""
    folder = tmp_path_factory.mktemp("hot")
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    more = items.limit(1).crossJoin(spark.range(HOT)).withColumns(
        {"l_orderkey": F.lit(10**7).cast("long"), "l_linenumber": (F.col("id") % 7).cast("int"), "l_partkey": F.col("id") * 13 + 5,
         "l_suppkey": F.col("id") % 11, "l_quantity": (F.col("id") % 50).cast("double")}
    ).drop("id")
    items.unionByName(more).write.parquet(f"{folder}/lineitem.parquet")
    shutil.copy(f"{SF}/orders.parquet", f"{folder}/orders.parquet")
    return str(folder)


def test_small_plans_are_the_nested_ones(spark):
    p = q.long_plans(spark, SF)
    nested = tables.plans(spark, SF)
    rooms = nested.select("plan_id", F.expr("inline(rooms)"))
    key = lambda df, *c: sorted(map(repr, map(tuple, df.select("plan_id", *c).collect())))
    assert key(p.rooms.withColumn("rid", F.col("rid").cast("int")).withColumn("coords", F.expr("transform(coords, v -> cast(v as int))")), "rid", "type", "coords") == key(rooms, "rid", "type", "coords")
    rel = nested.select("plan_id", F.expr("inline(spatial)"))
    ints = {"rid_a": F.col("rid_a").cast("int"), "rid_b": F.col("rid_b").cast("int")}
    assert key(p.relations.withColumns(ints), "rid_a", "rid_b", "direction") == key(rel, "rid_a", "rid_b", "direction")
    edges = nested.select("plan_id", F.posexplode("edges").alias("pos", "e")).select("plan_id", "pos", "e.pair", F.size("e.door").alias("n"))
    own = p.edges.select("plan_id", F.col("pos").cast("int").alias("pos"), F.expr("transform(pair, v -> cast(v as int))").alias("pair"), F.size("door").alias("n"))
    assert key(own, "pos", "pair", "n") == key(edges, "pos", "pair", "n")


def test_one_hot_order(spark, hot_folder):
    """An order with many rooms is whole in every long result; only numbered plans leave it out."""
    p = q.long_plans(spark, hot_folder)
    of = lambda df: df.filter("plan_id = '10000000'")
    assert of(p.rooms).count() == HOT + 1 and of(p.sizes).first()["n"] == HOT
    rel = of(p.relations)
    assert rel.count() == HOT * (HOT - 1) // 2
    assert rel.agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (rel.count(), 0, HOT * (HOT - 1) // 2 - 1)
    centre = {r["rid"]: r for r in of(lp.centres(p.rooms)).collect()}
    ask = rel.filter("rid_a in (1, 64, 65, 700) and rid_b % 97 = 0").limit(60).collect()
    pairs = spark.createDataFrame(
        [(r["rid_a"], r["rid_b"], centre[r["rid_b"]]["cx"] - centre[r["rid_a"]]["cx"], centre[r["rid_b"]]["cy"] - centre[r["rid_a"]]["cy"]) for r in ask],
        "a long, b long, dx double, dy double",
    )
    want = {(r["a"], r["b"]): r["d"] for r in pairs.withColumn("d", F.expr(g.direction_built("dx", "dy"))).collect()}
    assert ask and {(r["rid_a"], r["rid_b"]): r["direction"] for r in ask} == want
    meta = QUERIES["score_metadata"](spark, hot_folder).filter("plan_id = '10000000'").first()
    down, right = HOT - 4, HOT - 1 - (HOT - 1) // 4
    assert (meta["total_rooms"], meta["n_edges"], meta["n_spatial"]) == (HOT, down + right, HOT * (HOT - 1) // 2)
    views = QUERIES["columnar_row_views"](spark, hot_folder).filter("plan_id = '10000000'").collect()
    assert {r["kind"]: r["n"] for r in views} == {"room": HOT + 1, "edge": down + right, "rel": HOT * (HOT - 1) // 2}
    assert tables.plans(spark, hot_folder).filter("plan_id = '10000000'").count() == 0


def test_chunks(spark):
    rows = spark.createDataFrame([("p", i, i * 2, None if i % 5 == 0 else "x") for i in range(100)], "plan_id string, pos long, a long, b string")
    chunks = lp.columnar_chunks(rows, ["a", "b"], chunk=7)
    assert chunks.count() == 15 and chunks.agg(F.max(F.size("items.a"))).first()[0] == 7
    back = lp.rows_of_chunks(chunks)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, rows.collect())))
