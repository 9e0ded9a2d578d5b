"""The share of relations kept by matched rooms, against the former expression."""

from pyspark.sql import functions as F

from planmill.functions import geometry as g
from planmill.functions.arrays import let
from planmill.operators.matching import share_of_relations


def test_share_of_relations_is_that_of_the_expression(spark):
    df = spark.createDataFrame(
        [
            (0, [(3, 0), (-1, 1)], [(0.0, 0.0), (5.0, 0.0)], [(3, -1, "right"), (-1, 3, "left"), (3, -1, "above"), (3, 9, "right"), (None, 3, "left")]),
            (1, [(3, 1), (-1, 0), (3, 0)], [(0.0, 0.0), (5.0, 5.0)], [(3, -1, "left"), (-1, 3, "right-below"), (3, 3, "right"), (3, -1, None)]),
            (2, [], [(0.0, 0.0)], [(1, 2, "right")]),
            (3, [], [], []),
            (4, [(1, 0)], [(2.0, 2.0)], [(None, 1, "left")]),
            (5, [(1, 0)], [(2.0, 2.0)], []),
            (6, None, None, None),
            (7, [(1, 0), (2, 1)], [(2.0, 2.0), (2.0, 8.0)], [(1, 2, d) for d in ("below", "above", "right")]),
        ],
        "k int, match array<struct<rid:int,out:int>>, _outs array<struct<cx:double,cy:double>>,"
        " spatial array<struct<rid_a:int,rid_b:int,direction:string>>",
    )
    known = "filter(spatial, s -> s.rid_a is not null and s.rid_b is not null)"
    place = lambda k: let(f"get(filter(match, z -> z.rid = {k}), 0).out", "o", "if(o is null, null, _outs[o])")
    ok = let(
        f"named_struct('a', {place('s.rid_a')}, 'b', {place('s.rid_b')})", "ab",
        f"coalesce({g.direction_scored('(ab.b.cx - ab.a.cx)', '(ab.b.cy - ab.a.cy)')} = s.direction, false)")
    want = (
        f"case when size(spatial) = 0 then 1D when size(match) = 0 then 0D when size({known}) = 0 then 1D"
        f" else size(filter({known}, s -> {ok})) / cast(size({known}) as double) end")
    rows = df.coalesce(1).select("k", share_of_relations(F.col("match"), F.col("_outs"), F.col("spatial")).alias("got"), F.expr(want).alias("want")).collect()
    assert [r for r in rows if r["k"] != 6 and r["got"] != r["want"]] == []
    assert {r["want"] for r in rows} >= {0.0, 0.5, 1.0}
