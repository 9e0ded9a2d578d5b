"""Connected regions of run tables: components, rooms, outlines, boxes and polygons.

A region never leaves its raster, and a raster has a fixed number of rows and columns, so the
runs of one (plan, code) are gathered and labelled in one pass; there is no iteration over jobs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planmill.constants import MIN_ROOM_AREA
from planmill.functions import geometry as g
from planmill.functions.arrays import components, let
from planmill.sources.raster import image_parts, runs_of

_SPAN = 65536


def label_runs(runs: str, connectivity: int = 4) -> str:
    """SQL text: runs (y, x0, x1, lab) with the label of their region's first run, y * 65536 + x0."""
    d = 0 if connectivity == 4 else 1
    touch = lambda p, r: (
        f"(({p}.y = {r}.y - 1 and {p}.x0 <= {r}.x1 + {d} and {p}.x1 >= {r}.x0 - {d})"
        f" or ({p}.y = {r}.y and {p}.x1 = {r}.x0 - 1))"
    )
    items = f"transform({runs}, r -> named_struct('y', r.y, 'x0', r.x0, 'x1', r.x1, 'lab', r.y * {_SPAN}L + r.x0))"
    return components(items, ["y", "x0", "x1"], touch)


def region_of_runs(group, y, x0, x1, connectivity: int = 4) -> np.ndarray:
    """For runs in (group, y, x0) order: the index of the first run of each run's region.

    A run's neighbours in the next row are a range of its runs, found by binary search; labels then
    fall to the smallest neighbour's and jump along until nothing changes.
    """
    d = 0 if connectivity == 4 else 1
    row = (group.astype(np.int64) << 20) + y
    span = np.int64(1 << 20)
    begin = np.searchsorted(row * span + x1, (row + 1) * span + x0 - d, "left")
    end = np.searchsorted(row * span + x0, (row + 1) * span + x1 + d, "right")
    count = np.maximum(end - begin, 0)
    one = np.repeat(np.arange(len(row)), count)
    two = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
    beside = np.flatnonzero((row[1:] == row[:-1]) & (x1[:-1] == x0[1:] - 1))
    one, two = np.concatenate([one, beside]), np.concatenate([two, beside + 1])
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], least)
        np.minimum.at(new, label[two], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(runs: DataFrame, keys=("plan_id", "g"), connectivity: int = 4) -> DataFrame:
    """(keys, lab, y, x0, x1): every run with its region's label, y * 65536 + x0 of its first run.

    The runs of one (plan, code) are gathered; a task labels those of a whole batch at once.
    """
    grouped = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    n = len(keys)

    def label(batches):
        for batch in batches:
            lists = batch.column(n)
            flat = lists.flatten()
            y, x0, x1 = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("y", "x0", "x1"))
            group = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            first = region_of_runs(group, y, x0, x1, connectivity)
            held = [batch.column(k).take(pa.array(group)) for k in range(n)]
            rest = [pa.array(y[first] * _SPAN + x0[first], pa.int64()), *(pa.array(v, pa.int32()) for v in (y, x0, x1))]
            yield pa.RecordBatch.from_arrays([*held, *rest], [*batch.schema.names[:n], "lab", "y", "x0", "x1"])

    fields = "".join(f"`{k}` {runs.schema[k].dataType.simpleString()}, " for k in keys)
    return grouped.mapInArrow(label, fields + "lab bigint, y int, x0 int, x1 int")


def label_images(images: DataFrame, connectivity: int = 4, inside: int | None = None, codes=None, made=None) -> DataFrame:
    """(plan_id, g, lab, y, x0, x1, problem): labelled runs of rasters, found in one pass over their bytes.

    As `runs_from_images` and `connected_components` together, without a shuffle: a region never
    leaves its raster. With `inside`, all codes but this one count as one (g = -1) and this one is
    left out. With `codes`, only runs of these are labelled. `made` as in `runs_from_images`.
    A raster that cannot be used gives one row of nulls with the `problem` and stops no other.
    """
    kind = images.schema["plan_id"].dataType.simpleString()
    names = ["plan_id", "g", "lab", "y", "x0", "x1", "problem"]

    def rows(batches):
        for ids, rasters in (made or image_parts)(batches):
            broken = [(i, raster) for i, raster in rasters if isinstance(raster, str)]
            found = [(i, raster) for i, raster in rasters if not isinstance(raster, str)]
            if found:
                owner, *columns = _labelled(found, connectivity, inside, codes)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), *columns, pa.nulls(len(owner), pa.string())], names
                )
            if broken:
                nothing = [pa.nulls(len(broken), t) for t in _KINDS]
                at, why = zip(*broken, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *nothing, pa.array(why)], names)

    return (images if made else images.select("plan_id", "height", "width", "data")).mapInArrow(
        rows, f"plan_id {kind}, g int, lab bigint, y int, x0 int, x1 int, problem string"
    )


_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _labelled(rasters, connectivity: int, inside: int | None, codes=None):
    """(owner, g, lab, y, x0, x1) of the runs of a list of (owner, codes), with their regions' labels; see `label_images`."""
    read = lambda raster: raster if inside is None else (raster != inside).astype(np.int8)
    owner, y, x0, x1, g = (v.astype(np.int64) for v in runs_of(rasters, read))
    if inside is not None or codes is not None:
        held = np.isin(g, [1] if inside is not None else codes)
        owner, y, x0, x1, g = (v[held] for v in (owner, y, x0, x1, g))
    if inside is not None:
        g = g - 2
    group = owner * 512 + g + 1
    order = np.argsort(group, kind="stable")
    owner, g, y, x0, x1, group = (v[order] for v in (owner, g, y, x0, x1, group))
    first = region_of_runs(group, y, x0, x1, connectivity)
    return owner, *(pa.array(v, t) for v, t in zip((g, y[first] * _SPAN + x0[first], y, x0, x1), _KINDS, strict=True))


def label_batch(images: DataFrame, external: int, connectivity: int = 4) -> DataFrame:
    """(plan_id, origin, fault, g, lab, y, x0, x1, problem) of a table of rasters with a `fault`, in one pass over their bytes.

    Every raster has a row without g, with its `problem` where decoding failed. One without fault and problem has besides
    the labelled runs of all codes but `external`, and, as g = -1, those of all its cells but external ones as one code.
    """
    kind = images.schema["plan_id"].dataType.simpleString()
    names = ["plan_id", "origin", "fault", "g", "lab", "y", "x0", "x1", "problem"]
    codes = [*range(external), *range(external + 1, 256)]

    def rows(batches):
        for batch in batches:
            keys = [batch.column(k) for k in range(3)]
            nothing = [pa.nulls(batch.num_rows, t) for t in _KINDS]
            sound = np.flatnonzero(~keys[2].is_valid().to_numpy(zero_copy_only=False))
            why = np.full(batch.num_rows, None)
            good = batch.take(pa.array(sound)).select([0, 3, 4, 5])
            begin = 0
            for ids, rasters in image_parts([good]):
                rasters = [(int(sound[begin + i]), raster) for i, raster in rasters]
                begin += len(ids)
                found = [r for r in rasters if not isinstance(r[1], str)]
                for at, reason in rasters:
                    why[at] = reason if isinstance(reason, str) else None
                for own in ({"inside": None, "codes": codes}, {"inside": external}) if found else ():
                    owner, *columns = _labelled(found, connectivity, **own)
                    owner = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(k.take(owner) for k in keys), *columns, pa.nulls(len(owner), pa.string())], names)
            yield pa.RecordBatch.from_arrays([*keys, *nothing, pa.array(why.tolist(), pa.string())], names)

    fields = f"plan_id {kind}, origin string, fault string, g int, lab bigint, y int, x0 int, x1 int, problem string"
    return images.select("plan_id", "origin", "fault", "height", "width", "data").mapInArrow(rows, fields)


def region_stats(labelled: DataFrame, keys=("plan_id", "g")) -> DataFrame:
    """(keys, lab, area, cx, cy, box): pixel count, pixel mean and bounding box of every region."""
    n = F.col("x1") - F.col("x0") + 1
    return labelled.groupBy(*keys, "lab").agg(
        F.sum(n).alias("area"),
        (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"),
        (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
        F.min("x0").alias("xa"), F.max("x1").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"),
    )


def bounding_box(df: DataFrame) -> DataFrame:
    """Door box: floor-midpoint centre and inclusive size, from xa, xb, ya, yb."""
    return df.withColumns(
        {
            "x": F.expr("cast(floor((xa + xb) / 2) as int)"), "y": F.expr("cast(floor((ya + yb) / 2) as int)"),
            "w": F.expr("xb - xa + 1"), "h": F.expr("yb - ya + 1"),
        }
    )


def largest_region(stats: DataFrame) -> DataFrame:
    """The largest region per plan, the first one on ties."""
    return stats.groupBy("plan_id").agg(
        F.max_by(F.struct("lab", "area", "xa", "xb", "ya", "yb"), F.struct("area", -F.col("lab"))).alias("m")
    ).select("plan_id", "m.*")


def border(runs) -> list[tuple[int, int]]:
    """Points (x, y) where the outer border of a region turns, from its runs (y, x0, x1) in order.

    The border is a chain of pixels, each next to the one before or touching it at a corner. It is found
    by walking along pixel edges with the region on the left, from the left edge of the first pixel
    downwards: where the pixel ahead on the right belongs to the region the walk turns to it, which joins
    parts that touch at a corner; else it goes straight or, at an end, turns left and stays at its pixel.
    Parts one pixel wide are walked on both sides.
    """
    left, right = min(r[1] for r in runs), max(r[2] for r in runs)
    top, wide = runs[0][0], right - left + 3
    inside = bytearray(wide * (runs[-1][0] - top + 3))
    for y, x0, x1 in runs:
        at = (y - top + 1) * wide + x0 - left + 1
        inside[at : at + x1 - x0 + 1] = b"\1" * (x1 - x0 + 1)
    # Headings down, right, up, left; what lies ahead of a pixel and to the right of that.
    ahead, aside = (wide, 1, -wide, -1), (-1, wide, 1, -wide)
    start = wide + runs[0][1] - left + 1
    pixel, heading, chain = start, 0, []
    while True:
        to = pixel + ahead[heading]
        if inside[to + aside[heading]]:
            pixel = to + aside[heading]
            heading = (heading - 1) & 3
            chain.append(pixel)
        elif inside[to]:
            pixel = to
            chain.append(pixel)
        else:
            heading = (heading + 1) & 3
        if pixel == start and heading == 0:
            break
    if not chain:
        return [(runs[0][1], top)]
    chain = [start, *chain[:-1]]
    n = len(chain)
    turns = [c for k, c in enumerate(chain) if c - chain[k - 1] != chain[(k + 1) % n] - c]
    return [(c % wide - 1 + left, c // wide - 1 + top) for c in turns]


def level_ring(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of a border as a ring of level and upright sides.

    A corner is a point where the border changes between level (diagonal counts as level) and upright. Along
    the ring each level side takes the half-to-even mean height of its two ends, each upright side the mean
    place. With fewer than four corners the points stay as they are.
    """
    n = len(points)
    level = [abs(points[(k + 1) % n][0] - p[0]) >= abs(points[(k + 1) % n][1] - p[1]) for k, p in enumerate(points)]
    corners = [list(p) for k, p in enumerate(points) if level[k - 1] != level[k]]
    if len(corners) < 4:
        return points
    for k, a in enumerate(corners):
        b = corners[(k + 1) % len(corners)]
        axis = 1 if abs(b[0] - a[0]) >= abs(b[1] - a[1]) else 0
        a[axis] = b[axis] = round((a[axis] + b[axis]) / 2)
    return [tuple(c) for c in corners]


def normalize_ring(points: str) -> str:
    """SQL text: turn the ring so that its signed area is not positive, start at the first smallest x + y."""
    turned = f"if({g.shoelace('q')} > 0, reverse(q), q)"
    first = "cast(array_position(transform(t, p -> p.x + p.y), array_min(transform(t, p -> p.x + p.y))) - 1 as int)"
    return let(points, "q", let(turned, "t", let(first, "n", g.rotate("t", "n"))))


def polygons(labelled: DataFrame, keys=("plan_id", "g")) -> DataFrame:
    """(keys, lab, coords) of every region whose border has at least four points.

    The runs of one region are gathered, at most those of one raster; a task walks the borders of a batch.
    """
    grouped = labelled.groupBy(*keys, "lab").agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    n = len(keys) + 1
    ring_type = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def walk(batches):
        for batch in batches:
            lists = batch.column(n)
            flat = lists.flatten()
            cells = list(zip(*(flat.field(f).to_pylist() for f in ("y", "x0", "x1")), strict=True))
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            rings = []
            for begin, end in zip(ends[:-1], ends[1:], strict=True):
                points = border(cells[begin:end])
                rings.append([{"x": x, "y": y} for x, y in level_ring(points)] if len(points) >= 4 else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(rings, ring_type)], [*batch.schema.names[:n], "ring"])

    fields = "".join(f"`{k}` {labelled.schema[k].dataType.simpleString()}, " for k in (*keys, "lab"))
    ring = grouped.mapInArrow(walk, fields + "ring array<struct<x:int,y:int>>").filter("ring is not null")
    return ring.select(*keys, "lab", F.expr(g.flatten_vertices(normalize_ring("ring"))).alias("coords"))


def rooms(labelled: DataFrame, min_area: int = MIN_ROOM_AREA) -> DataFrame:
    """Room regions with their polygon, numbered 1.. by pixel-mean y, then x."""
    stats = region_stats(labelled).filter(F.col("area") >= min_area)
    shaped = stats.join(polygons(labelled), ["plan_id", "g", "lab"])
    return shaped.withColumn(
        "rid", F.row_number().over(W.partitionBy("plan_id").orderBy("cy", "cx", "g", "lab"))
    )


def outline(inside: DataFrame) -> DataFrame:
    """(plan_id, coords) of the largest region of all cells that are not external, from their labelled runs."""
    keys = ("plan_id", "g")
    largest = largest_region(region_stats(inside, keys)).select("plan_id", "lab")
    return polygons(inside.join(largest, ["plan_id", "lab"]), keys).select("plan_id", "coords")
