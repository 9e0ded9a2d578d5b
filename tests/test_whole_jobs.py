"""Whole rows, and work done once a row."""

import re

import numpy as np

import __spark_entry__ as entry
from planmill.operators import adjacency, matching

SF = "/root/testdata/sf0.001"


def test_ingest_returns_every_row_as_it_is(spark):
    df = entry.queries()["ingest_jsonl"](spark, SF)
    assert df.columns == ["plan_id", "variant", "kind", "pos", "val"]
    assert "md5" not in entry.oracle_sql()["ingest_jsonl"]


def test_error_mask_parses_once_a_sequence(spark):
    """The mask looks at a bound list for each token; the parse must not stand inside that loop."""
    plan = entry.queries()["error_mask"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    looked = re.findall(r"array_contains\((.{0,20})", plan)
    assert looked and all(x.startswith("lambda q") for x in looked), looked


def test_neighbours_by_batches_of_rasters(spark):
    """Against single pixels, on random rasters; and without a row for every run and neighbouring line."""
    draw = np.random.default_rng(5)
    runs, wanted = [], set()
    for plan in range(30):
        raster = draw.integers(1, 6, (6, 9))
        raster[draw.random(raster.shape) < 0.5] = 0
        for y, x in zip(*np.nonzero(raster), strict=True):
            runs.append((str(plan), int(raster[y, x]), int(y), int(x), int(x)))
            for other in raster[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].reshape(-1).tolist():
                if raster[y, x] < other:
                    wanted.add((str(plan), int(raster[y, x]), other))
    df = spark.createDataFrame(runs, "plan_id string, rid int, y int, x0 int, x1 int")
    got = adjacency.direct_pairs(df)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_door_rooms_at_the_border_of_a_raster(spark):
    """A door in the corner reaches over the border; the first two rooms by area, then number."""
    runs = [("p", 1, y, 0, 1) for y in range(4)] + [("p", 2, y, 2, 3) for y in range(4)] + [("q", 3, 0, 0, 1)]
    runs = spark.createDataFrame(runs, "plan_id string, rid int, y int, x0 int, x1 int")
    door = "array(named_struct('y', 0, 'x0', 1, 'x1', 1), named_struct('y', 0, 'x0', 2, 'x1', 2)) as px"
    doors = spark.createDataFrame([("p", 0), ("q", 1)], "plan_id string, door_id int").selectExpr("*", door, "1 as xa", "2 as xb", "0 as ya", "0 as yb")
    got = adjacency.door_pairs(runs, doors, kernel=3)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["plan_id"], r["a"], r["b"], r["door_id"], tuple(r["door"])) for r in got.collect()] == [("p", 1, 2, 0, (1, 0, 2, 1))]


def test_few_places_are_matched_without_arrays():
    draw = np.random.default_rng(2)
    for _ in range(500):
        wanted, answered = (draw.integers(0, 5, (draw.integers(1, 3), 2)).astype(float) for _ in range(2))
        few = matching.match_few(wanted.tolist(), answered.tolist())
        assert few is None or few == matching.match_places(wanted, answered)
