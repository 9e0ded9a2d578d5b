"""Steps that were made faster: same results, made once a row."""

from pyspark.sql import functions as F

from planmill.functions import geometry as g
from planmill.operators import parse
from planmill.operators.shapes import ring_distance


def test_answers_are_read_in_batches(spark):
    closed = "<ROOM> <X:3> <TYPE:a> <Y:999> <TYPE:b> <END_ROOM>"
    door = "<DOOR> <X:1> <Y:2> <SEP_DOOR> <X:3> <Y:4> <X:5> <END_DOOR>"
    texts = {
        "whole": f"<ROOM> <OUTPUT> <FRONT_DOOR> <END_DOOR> {closed} {door} <DOOR> <X:1> <END_DOOR> <FRONT_DOOR> <Y:1> <Y:2> <X:-3> <X:4> <END_DOOR> <ROOM> <X:1>",
        "none": f"<OUTPUT> <FRONT_DOOR> <NO_DOOR> <END_DOOR> <ROOM> <END_ROOM> <END_OUTPUT> {closed}",
        "open": "<OUTPUT> <ROOM> <X:1>",
        "before": closed,
    }
    rows = [(k, v.split(" ")) for k, v in texts.items()] + [("empty", []), ("null", None)]
    df = parse.parse_answer(spark.createDataFrame(rows, "k string, tokens array<string>"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.plan for r in df.collect()}
    assert [got[k] for k in ("open", "before", "empty", "null")] == [None] * 4
    whole = got["whole"].asDict(recursive=True)
    assert whole["rooms"] == [{"rid": 0, "type": "b", "coords": [3, 255]}]
    assert whole["edges"] == [{"pair": [0, 0], "door": [{"x": 1, "y": 2, "w": 3, "h": 4}]}]
    assert whole["front_door"] == {"x": 1, "y": 2, "w": 0, "h": 4} and whole["spatial"] == []
    assert got["none"].front_door is None and got["none"].rooms[0].type == "unknown" and got["none"].rooms[0].coords == []


def test_distance_to_a_ring(spark):
    ring = [0, 0, 0, 10, 10, 10, 10, 0]
    rows = [(0, 3.0, 4.0, ring), (1, -3.0, -4.0, ring), (2, 13.0, 5.0, [*ring, 7]), (3, 3.0, 4.0, [0, 0]), (4, 1.0, 1.0, []), (5, None, 1.0, ring),
            (6, 1.0, 1.0, None), (7, 2.0, 0.0, [0, 0, 0, None, 4, 3, 4, 0])]
    df = spark.createDataFrame(rows, "k int, x double, y double, coords array<int>")
    got = {r.k: r.d for r in df.select("k", ring_distance(df.x, df.y, df.coords).alias("d")).collect()}
    old = {r.k: r.d for r in df.select("k", F.expr(g.point_ring_distance("x", "y", f"({g.vertices('coords')})")).alias("d")).collect()}
    assert got == {0: 3.0, 1: 5.0, 2: 3.0, 3: 5.0, 4: None, 5: None, 6: None, 7: 0.0}
    assert got == old
