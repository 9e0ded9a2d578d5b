"""Relations made in Arrow batches, against the column expression; JSON lines that are made once."""

import random

from pyspark.sql import functions as F

from planmill.functions import geometry as g
from planmill.operators.relations import relations_of_centres
from planmill.queries import records

SF = "/root/testdata/sf0.001"


def test_relations_are_those_of_the_expression(spark):
    rnd = random.Random(8)
    some = lambda v: None if rnd.random() < 0.1 else v
    rows = []
    for k in range(300):
        rooms = [
            some((some(rnd.randrange(5)), some(rnd.choice(["outline", "bedroom", "kitchen"])), [rnd.randrange(9) for _ in range(rnd.choice([2, 3, 4]))]))
            for _ in range(rnd.randrange(7))
        ]
        rows.append((k, some(rooms)))
    df = spark.createDataFrame(rows, "k int, rooms array<struct<rid:int,type:string,coords:array<int>>>").coalesce(1)
    centres = (
        f"transform(filter(rooms, r -> r.type <> 'outline'), r -> named_struct('rid', r.rid,"
        f" 'cx', {g.mean(g.xs('r.coords'))}, 'cy', {g.mean(g.ys('r.coords'))}))"
    )
    direction = g.direction_built("(b.cx - a.cx)", "(b.cy - a.cy)")
    want = (
        f"array_sort(flatten(transform(c, a -> transform(filter(c, b -> b.rid > a.rid),"
        f" b -> named_struct('rid_a', a.rid, 'rid_b', b.rid, 'direction', {direction})))))"
    )
    made = df.withColumn("c", F.expr(centres)).select(
        relations_of_centres(F.col("c")).alias("centres"), F.expr(want).alias("want")
    )
    for r in made.collect():
        assert r["centres"] == r["want"]


def test_first_plan_by_file_makes_lines_once(spark):
    """Three branches made all lines anew, and whole lines were sorted for the file alone."""
    plan = records.first_plan_by_file(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 1 and "Union" not in plan
    assert "value" not in plan.split("Generate")[0]
