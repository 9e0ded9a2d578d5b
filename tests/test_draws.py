"""Draws made in Arrow batches, against the single ones."""

from pyspark.sql import functions as F

from planmill.functions.draws import drawn, gaussian_steps, u
from planmill.operators import augment as a


def test_draws_of_a_batch_are_the_single_draws(spark):
    df = spark.createDataFrame([("7", 1, 3), ("é|", 2, 0), (None, 3, 2)], "plan_id string, variant int, n int")
    got = df.select(
        "n", drawn("a", "n", 9).alias("counted"), drawn("b", ["x", ""], 9).alias("named"),
        F.expr(f"transform(filter(sequence(0, n), i -> i < n), i -> {u('a', 'i', 9)})").alias("each"),
        F.expr("array(" + u("b", "'x'", 9) + ", " + u("b", "''", 9) + ")").alias("both"),
    ).collect()
    assert [len(r["counted"]) for r in got] == [3, 0, 2]
    assert all(r["counted"] == r["each"] and r["named"] == r["both"] for r in got)


def test_gaussian_steps_are_those_of_single_draws(spark):
    df = spark.sql("select '5' plan_id, 1 variant, array(3, null) rids, array(4, 2) n, true w union all select '6', 1, array(1), array(4), false")
    got = df.select(gaussian_steps("transform(rids, r -> cast(r as string))", "n", "w", 3.0).alias("s")).collect()
    item = "concat(cast(rids[0] as string), ':', cast(i as string))"
    z = f"sqrt(-2D * ln(1D - {u('noise_r', item)})) * cos(2D * pi() * {u('noise_a', item)})"
    want = df.select(F.expr(f"transform(sequence(0, 3), i -> cast(rint({z} * 3D) as int))").alias("z")).first()["z"]
    assert got[0]["s"][0] == want and len(got[0]["s"][1]) == 2 and got[1]["s"] is None


def test_room_numbers_without_a_batch_draw_are_drawn(spark):
    rooms = "array(named_struct('rid', 40, 'type', 'x', 'coords', array(0, 0, 0, 9, 9, 9, 9, 0)))"
    df = spark.sql(f"select '1' plan_id, 1 variant, {rooms} rooms")
    start = df.select(F.expr(f"cast(floor({u('vertex', '40')} * 4) as int) s")).first()["s"]
    ring = [0, 0, 0, 9, 9, 9, 9, 0]
    assert a.shuffle_vertex_order(df).first()["rooms"][0]["coords"] == ring[2 * start :] + ring[: 2 * start]
