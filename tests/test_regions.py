"""Regions, polygons, doors and adjacency on small drawings."""

import pytest
from pyspark.sql import functions as F

import numpy as np

from planmill.constants import CODE_EXTERNAL
from planmill.operators import adjacency, doors, regions
from planmill.plans import extract
from planmill.sources import jsonl, raster
from planmill.sources.raster import runs_from_pixels


def pixels(spark, arts, g=1):
    rows = [(name, y, x, g) for name, art in arts.items() for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "plan_id string, y int, x int, g int")


def test_connectivity(spark):
    runs = runs_from_pixels(pixels(spark, {"d": ["##..", "##..", "..##", "..##"], "u": ["#.#", "#.#", "###"]}))
    count = lambda c: {r["plan_id"]: r["n"] for r in regions.connected_components(runs, connectivity=c).groupBy("plan_id").agg(F.countDistinct("lab").alias("n")).collect()}
    assert count(4) == {"d": 2, "u": 1}
    assert count(8) == {"d": 1, "u": 1}


def test_polygons(spark):
    arts = {
        "box": ["....", ".###", ".###", ".###"],
        "ell": ["###...", "###...", "###...", "######", "######", "######"],
        "bar": ["#####"],
        "hole": ["######", "######", "##..##", "##..##", "######", "######"],
    }
    got = {r["plan_id"]: r["coords"] for r in regions.polygons(regions.connected_components(runs_from_pixels(pixels(spark, arts)))).collect()}
    assert got["box"] == [1, 1, 1, 3, 3, 3, 3, 1]
    # The inner corner is cut diagonally and both ends of the level side take their even mean.
    assert got["ell"] == [0, 0, 0, 5, 5, 5, 5, 2, 2, 2, 2, 0]
    assert got["hole"] == [0, 0, 0, 5, 5, 5, 5, 0]
    assert "bar" not in got


AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]


def walked_border(cells):
    """Pixels of the outer border by looking around each pixel, backwards from where the walk came from."""
    start = min(cells, key=lambda c: (c[1], c[0]))
    if len(cells) == 1:
        return [start]
    at, came, out, first = start, (start[0] - 1, start[1]), [], None
    while True:
        # From the empty neighbour we looked at last, on with y down: west, south-west, south, ...
        k = AROUND.index((came[0] - at[0], came[1] - at[1]))
        for step in range(1, 9):
            d = AROUND[(k - step) % 8]
            there = (at[0] + d[0], at[1] + d[1])
            if there in cells:
                break
            came = there
        if (at, there) == first:
            return out
        first = first or (at, there)
        out.append(at)
        at = there


def ring_of_border(pixels):
    """Corners of a pixel chain and sides made level and upright, point by point."""
    n = len(pixels)
    step = lambda k: (pixels[(k + 1) % n][0] - pixels[k % n][0], pixels[(k + 1) % n][1] - pixels[k % n][1])
    points = [p for k, p in enumerate(pixels) if step(k - 1 + n) != step(k)] if n > 1 else pixels
    m = len(points)
    if m < 4:
        return None
    flat = lambda a, b: abs(b[0] - a[0]) >= abs(b[1] - a[1])
    corners = [list(points[k]) for k in range(m) if flat(points[k - 1], points[k]) != flat(points[k], points[(k + 1) % m])]
    if len(corners) < 4:
        corners = [list(p) for p in points]
    else:
        for k in range(len(corners)):
            a, b = corners[k], corners[(k + 1) % len(corners)]
            c = 1 if flat(a, b) else 0
            a[c] = b[c] = int(np.rint((a[c] + b[c]) / 2))
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, corners[1:] + corners[:1], strict=True))
    if area > 0:
        corners.reverse()
    first = min(range(len(corners)), key=lambda k: (sum(corners[k]), k))
    return [v for c in corners[first:] + corners[:first] for v in c]


def test_borders_of_random_regions(spark):
    """Rings against a walk around single pixels: corner contacts, thin parts and holes included."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k in range(250):
        h, w = rng.integers(1, 10, 2)
        raster_ = rng.random((h, w)) < rng.choice([0.4, 0.6, 0.8])
        if not raster_.any():
            continue
        rows += [(f"p{k}", int(y), int(x), 1) for y, x in zip(*np.nonzero(raster_), strict=True)]
    df = spark.createDataFrame(rows, "plan_id string, y int, x int, g int")
    labelled = regions.connected_components(runs_from_pixels(df)).persist()
    cells = {}
    for r in labelled.collect():
        cells.setdefault((r["plan_id"], r["lab"]), set()).update((x, r["y"]) for x in range(r["x0"], r["x1"] + 1))
    for key, own in cells.items():
        ring = ring_of_border(walked_border(own))
        if ring:
            want[key] = ring
    got = {(r["plan_id"], r["lab"]): r["coords"] for r in regions.polygons(labelled).collect()}
    assert got == want and len(want) > 200
    assert regions.border([(0, 3, 7)]) == [(3, 0), (7, 0)] and regions.border([(2, 5, 5)]) == [(5, 2)]


def test_room_area_limit(spark):
    arts = {"a29": ["#" * 29], "a30": ["######"] * 5, "a25": ["#####"] * 5}
    runs = regions.connected_components(runs_from_pixels(pixels(spark, arts)))
    assert {r["plan_id"] for r in regions.rooms(runs).collect()} == {"a30"}


@pytest.mark.parametrize("depth", [8])
def test_doors(spark, depth):
    arts = {
        "rect": ["#####"],
        "tiny": ["####"],
        "ell": ["######", "##....", "##....", "##....", "##...."],
        "steps": ["###...", "###...", ".####.", "..####"],
    }
    found = doors.interior_doors(regions.connected_components(runs_from_pixels(pixels(spark, arts))), max_depth=depth)
    got = {}
    for r in found.collect():
        got.setdefault(r["plan_id"], []).append((r["xa"], r["xb"], r["ya"], r["yb"]))
    assert got["rect"] == [(0, 4, 0, 0)] and "tiny" not in got
    assert sorted(got["ell"]) == [(0, 1, 1, 4), (0, 5, 0, 0)]


def test_pairs_and_doors(spark):
    runs = spark.createDataFrame(
        [("p", 1, y, 0, 4) for y in range(5)] + [("p", 2, y, 6, 10) for y in range(5)] + [("p", 3, y, 0, 4) for y in range(5, 9)],
        "plan_id string, rid int, y int, x0 int, x1 int")
    assert [(r["a"], r["b"]) for r in adjacency.direct_pairs(runs).orderBy("a").collect()] == [(1, 3)]
    door = spark.createDataFrame([("p", 0, [(1, 5, 5), (2, 5, 5), (3, 5, 5)], 5, 5, 1, 3)],
                                 "plan_id string, door_id int, px array<struct<y:int,x0:int,x1:int>>, xa int, xb int, ya int, yb int")
    got = adjacency.edges(runs, door).orderBy("a", "b").collect()
    assert [(r["a"], r["b"], len(r["doors"])) for r in got] == [(1, 2, 1), (1, 3, 0)]


IMAGE = "plan_id string, origin string, height int, width int, channels int, data binary"


def image(plan_id, codes, origin=None, channels=4, height=None, cut=None):
    h, w = codes.shape
    data = np.zeros((h, w, 4), np.uint8)
    data[:, :, 1] = codes
    return (plan_id, origin or f"a/{plan_id}.png", h if height is None else height, w, channels, bytearray(data.tobytes()[:cut]))


def test_runs_and_labels_of_images(spark):
    """One pass over the bytes finds what pixel tables and grouped runs give."""
    rng = np.random.default_rng(3)
    rasters = {f"r{k}": rng.choice([1, 2, CODE_EXTERNAL], (rng.integers(1, 12), rng.integers(1, 12))).astype(np.uint8) for k in range(40)}
    images = spark.createDataFrame([image(k, c) for k, c in rasters.items()], IMAGE).repartition(3)
    runs = raster.runs_from_images(images)
    pixels = spark.createDataFrame(
        [(k, y, x, int(c[y, x])) for k, c in rasters.items() for y in range(c.shape[0]) for x in range(c.shape[1])],
        "plan_id string, y int, x int, g int",
    )
    rows = lambda df: sorted(map(tuple, df.select("plan_id", "g", "y", "x0", "x1").collect()))
    assert rows(runs) == rows(runs_from_pixels(pixels))
    for connectivity in (4, 8):
        got = regions.label_images(images, connectivity).drop("problem").select("plan_id", "g", "lab", "y", "x0", "x1")
        want = regions.connected_components(runs, connectivity=connectivity).select("plan_id", "g", "lab", "y", "x0", "x1")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    inside = regions.label_images(images, inside=CODE_EXTERNAL).groupBy("plan_id").agg(F.sum(F.expr("x1 - x0 + 1")).alias("n"))
    assert {r["plan_id"]: r["n"] for r in inside.collect()} == {k: int((c != 13).sum()) for k, c in rasters.items() if (c != 13).any()}
    assert "Window" not in raster.runs_from_pixels(pixels)._jdf.queryExecution().executedPlan().toString()


def test_failures_stay_alone(spark, tmp_path):
    room = np.full((12, 12), CODE_EXTERNAL, np.uint8)
    room[2:9, 2:9] = 1
    nothing = np.full((5, 5), CODE_EXTERNAL, np.uint8)
    rows = [
        image("good", room), image("empty", nothing), image("thin", room, height=-1), image("rgb", room, channels=3),
        image("short", room, cut=50), image("twice", room, "a/twice.png"), image("twice", nothing, "b/twice.png"),
        image(None, room, "a/none.png"), ("null", "a/null.png", 4, 4, 4, None), ("nothing", "a/nothing.png", None, None, None, None),
    ]
    images = spark.createDataFrame(rows, IMAGE)
    batch = extract.run_batch(images)
    records = {r["plan_id"]: r for r in batch.records.collect()}
    assert set(records) == {"good", "empty", "twice"}
    assert [len(records[k]["rooms"]) for k in ("good", "empty", "twice")] == [2, 1, 2]
    assert records["empty"]["rooms"][0]["coords"] == [] and len(records["good"]["rooms"][0]["coords"]) == 8
    assert sorted((r["origin"], r["stage"], r["reason"]) for r in batch.ledger.collect()) == [
        ("a/none.png", "read", "no_id"), ("a/nothing.png", "read", "unreadable"), ("a/null.png", "read", "size"),
        ("a/rgb.png", "read", "channels"), ("a/short.png", "read", "size"), ("a/thin.png", "read", "unreadable"),
        ("b/twice.png", "read", "duplicate_id"),
    ]
    counts = extract.write_batch(images, f"{tmp_path}/r", f"{tmp_path}/l", jsonl.write_shards)
    assert counts == {
        "success": 3, "failed": 7, "total": 10,
        "by_reason": {"read:no_id": 1, "read:unreadable": 2, "read:channels": 1, "read:size": 2, "read:duplicate_id": 1},
    }
    assert jsonl.read_lines(spark, f"{tmp_path}/r", "*").count() == 3
    none = extract.run_batch(images.limit(0))
    assert none.records.count() == none.ledger.count() == 0


def test_a_raster_that_decoding_refuses(spark):
    """Decoding is guarded by itself, whatever the checks before it let through."""
    room = np.full((6, 6), 1, np.uint8)
    images = spark.createDataFrame([image("good", room), image("bad", room, cut=7)], IMAGE)
    got = {(r["plan_id"], r["problem"]) for r in regions.label_images(images).collect()}
    assert got == {("good", None), ("bad", "ValueError")}
