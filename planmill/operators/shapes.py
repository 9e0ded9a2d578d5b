"""Geometry of answered rooms over Arrow batches: angles, common areas and rooms in reach of doors.

The vertices of a batch lie in flat arrays. Each step lists what is to be compared (sides of a ring, sides of two
rings, slabs and sides) as pairs of places in them, and compares all pairs at once.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.constants import DOOR_REACH, OUTLINE, RIGHT_ANGLE_TOL
from planmill.functions.flat import crossed, distinct, lists_of, offsets, ranges

#: Pairs that are compared at a time.
AT_ONCE = 1 << 20


def _batches(count):
    """Slices of items whose counts together are at most AT_ONCE, an item at least."""
    at, total = 0, np.concatenate([[0], np.cumsum(count)])
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, "right")) - 1)
        yield slice(at, end)
        at = end


class Rooms:
    """Vertices x, y of all rooms of a batch with the place `after` and `before` each in its ring, and the token `idx` of each.

    Room r has the vertices first[r] .. first[r] + size[r] - 1 and stands in `row[r]`; `order[r]` is its place among the
    rooms of the row that are no outline, -1 for one that is.
    """

    def __init__(self, lists: pa.Array):
        self.n_rows = len(lists)
        _, length = lists_of(lists)
        flat = lists.flatten()
        self.row = np.repeat(np.arange(len(lists)), length)
        out = pc.fill_null(pc.not_equal(flat.field("type"), OUTLINE), False).to_numpy(zero_copy_only=False)
        so_far = np.cumsum(out)
        before = (so_far - out)[np.minimum((np.cumsum(length) - length)[self.row], max(len(out) - 1, 0))] if len(out) else so_far
        self.order = np.where(out, so_far - 1 - before, -1)
        self.first, self.size = lists_of(flat.field("points"))
        points = flat.field("points").flatten()
        self.x, self.y = (points.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "xy")
        self.idx = flat.field("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.room = np.repeat(np.arange(len(self.first)), self.size)
        place = np.arange(len(self.x))
        first, last = self.first[self.room], (self.first + self.size - 1)[self.room]
        self.after = np.where(place == last, first, place + 1)
        self.before = np.where(place == first, last, place - 1)
        if len(points) and max(np.abs(self.x).max(), np.abs(self.y).max()) >= 1 << 30:
            # Products of differences need more than 64 bits.
            self.x, self.y = self.x.astype(object), self.y.astype(object)
        self.fx, self.fy = self.x.astype(np.float64), self.y.astype(np.float64)


# --- angles ---------------------------------------------------------------------------------

def _angles(r: Rooms):
    """(vertices with two sides in a room of three or more, whether the angle there is right)."""
    px, py = r.fx[r.before] - r.fx, r.fy[r.before] - r.fy
    nx, ny = r.fx[r.after] - r.fx, r.fy[r.after] - r.fy
    l1, l2 = px * px + py * py, nx * nx + ny * ny
    at = np.flatnonzero((r.size[r.room] >= 3) & (l1 > 0) & (l2 > 0))
    dot = (px * nx + py * ny)[at]
    return at, np.abs(dot / (np.sqrt(l1[at]) * np.sqrt(l2[at]))) <= RIGHT_ANGLE_TOL


# --- rings ----------------------------------------------------------------------------------

def _turn(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _on(ax, ay, bx, by, px, py, turn):
    return (
        (turn == 0) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx))
        & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
    )


def _clash(s, t, next_, closing):
    """Sides s and t of one ring cross or touch; of neighbours, t folds back on s (s on t where t is before s)."""
    s, t = [np.where(closing, b, a) for a, b in zip(s, t)], [np.where(closing, a, b) for a, b in zip(s, t)]
    (ax, ay, bx, by), (cx, cy, dx, dy) = s, t
    with_c, with_d = _turn(ax, ay, bx, by, cx, cy), _turn(ax, ay, bx, by, dx, dy)
    with_a, with_b = _turn(cx, cy, dx, dy, ax, ay), _turn(cx, cy, dx, dy, bx, by)
    back = (with_d == 0) & ((bx - ax) * (dx - cx) + (by - ay) * (dy - cy) < 0)
    touch = (
        ((with_c * with_d < 0) & (with_a * with_b < 0))
        | _on(ax, ay, bx, by, cx, cy, with_c) | _on(ax, ay, bx, by, dx, dy, with_d)
        | _on(cx, cy, dx, dy, ax, ay, with_a) | _on(cx, cy, dx, dy, bx, by, with_b)
    )
    return np.where(next_ | closing, back, touch).astype(bool)


def _simple(r: Rooms, rooms):
    """Whether the rings of the rooms neither cross, touch nor fold back on themselves; repeated vertices count once."""
    kept = (r.x != r.x[r.after]) | (r.y != r.y[r.after])
    place = np.flatnonzero(kept)
    size = np.bincount(r.room[place], minlength=len(r.first))[rooms]
    first = np.searchsorted(place, r.first[rooms])
    x, y = r.x[place], r.y[place]
    good = size >= 3
    # Side i of a ring meets the sides after it.
    side, ring = ranges(first, size)
    later = (first + size)[ring] - 1 - side
    for part in _batches(later):
        j, of = ranges(side[part] + 1, later[part])
        i, k = side[part][of], ring[part][of]
        end = lambda v: np.where(v + 1 == (first + size)[k], first[k], v + 1)
        i2, j2 = end(i), end(j)
        next_ = j == i + 1
        closing = ~next_ & (i == first[k]) & (j == (first + size)[k] - 1)
        clash = _clash((x[i], y[i], x[i2], y[i2]), (x[j], y[j], x[j2], y[j2]), next_, closing)
        good[k[clash]] = False
    return good


def _usable(r: Rooms):
    """(rooms with an area and a simple ring, without outlines; their areas)."""
    twice = np.zeros(len(r.first), r.x.dtype)
    np.add.at(twice, r.room, r.x * r.y[r.after] - r.x[r.after] * r.y)
    area = np.abs(twice).astype(np.float64) / 2
    rooms = np.flatnonzero((r.order >= 0) & (r.size >= 3) & (area > 0))
    box = r.size[rooms] == 4
    x, y = (v[np.minimum(r.first[rooms][:, None] + np.arange(4), len(v) - 1)] if len(rooms) else np.zeros((0, 4)) for v in (r.x, r.y))
    upright = (x[:, 0] == x[:, 1]) & (y[:, 1] == y[:, 2]) & (x[:, 2] == x[:, 3]) & (y[:, 3] == y[:, 0])
    level = (y[:, 0] == y[:, 1]) & (x[:, 1] == x[:, 2]) & (y[:, 2] == y[:, 3]) & (x[:, 3] == x[:, 0])
    good = box & (upright | level)
    good[~good] = _simple(r, rooms[~good])
    return rooms[good], area[rooms[good]]


# --- common areas ----------------------------------------------------------------------------

def _near(r: Rooms, rooms):
    """Pairs of usable rooms of a row whose bounding boxes share an area."""
    if not len(rooms):
        return rooms, rooms
    place, owner = ranges(r.first[rooms], r.size[rooms])
    starts = np.cumsum(r.size[rooms]) - r.size[rooms]
    x0, x1 = (f.reduceat(r.fx[place], starts) for f in (np.minimum, np.maximum))
    y0, y1 = (f.reduceat(r.fy[place], starts) for f in (np.minimum, np.maximum))
    row = r.row[rooms]
    later = np.searchsorted(row, row, "right") - 1 - np.arange(len(row))
    found = [(rooms[:0], rooms[:0])]
    for part in _batches(later):
        a = np.arange(len(row))[part]
        b, of = ranges(a + 1, later[part])
        a = a[of]
        hit = (x0[b] < x1[a]) & (x1[b] > x0[a]) & (y0[b] < y1[a]) & (y1[b] > y0[a])
        found.append((rooms[a[hit]], rooms[b[hit]]))
    return tuple(np.concatenate(v) for v in zip(*found))


class Sides:
    """Sides of all rooms that are not level, from low to high y."""

    def __init__(self, r: Rooms):
        place = np.flatnonzero(r.fy != r.fy[r.after])
        up = r.fy[place] < r.fy[r.after[place]]
        low, high = np.where(up, place, r.after[place]), np.where(up, r.after[place], place)
        self.x1, self.y1, self.x2, self.y2 = r.fx[low], r.fy[low], r.fx[high], r.fy[high]
        self.size = np.bincount(r.room[place], minlength=len(r.first))
        self.first = np.cumsum(self.size) - self.size

    def x_at(self, side, y):
        return self.x1[side] + (y - self.y1[side]) * (self.x2[side] - self.x1[side]) / (self.y2[side] - self.y1[side])


def _spans(s: Sides, rooms, pair, mid):
    """Stretches of line `mid` of each slab inside the slab's room: (slab, left x, left side, right x, right side)."""
    room = rooms[pair]
    side, slab = ranges(s.first[room], s.size[room])
    hit = (s.y1[side] < mid[slab]) & (s.y2[side] > mid[slab])
    side, slab = side[hit], slab[hit]
    x = s.x_at(side, mid[slab])
    order = np.lexsort((x, slab))
    side, slab, x = side[order], slab[order], x[order]
    # A line crosses a ring an even number of times; one that rounding puts on a vertex may miss a side.
    n = np.bincount(slab, minlength=len(mid))
    whole = np.arange(len(slab)) - (np.cumsum(n) - n)[slab] < (n // 2 * 2)[slab]
    side, slab, x = side[whole], slab[whole], x[whole]
    return slab[::2], x[::2], side[::2], x[1::2], side[1::2]


def _pieces(s: Sides, a, b):
    """Trapezoids whose union is the common area of rooms a[k] and b[k]: (k, lo, hi, left side, right side, area).

    Between two neighbouring cuts (all vertex heights and all crossings) no side starts, ends or
    crosses, so every common stretch is a trapezoid and the area is exact.
    """
    p, q, k = crossed(s.first[a], s.size[a], s.first[b], s.size[b])
    slant = (s.x1[p] != s.x2[p]) | (s.x1[q] != s.x2[q])
    p, q, k = p[slant], q[slant], k[slant]
    px, py, qx, qy = s.x2[p] - s.x1[p], s.y2[p] - s.y1[p], s.x2[q] - s.x1[q], s.y2[q] - s.y1[q]
    den = px * qy - py * qx
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((s.x1[q] - s.x1[p]) * qy - (s.y1[q] - s.y1[p]) * qx) / den
        y = s.y1[p] + t * py
        hit = (den != 0) & (t >= 0) & (t <= 1) & (y >= s.y1[q]) & (y <= s.y2[q])
    side_a, of_a = ranges(s.first[a], s.size[a])
    side_b, of_b = ranges(s.first[b], s.size[b])
    cut = np.concatenate([s.y1[side_a], s.y2[side_a], s.y1[side_b], s.y2[side_b], y[hit]])
    of = np.concatenate([of_a, of_a, of_b, of_b, k[hit]])
    order = np.lexsort((cut, of))
    cut, of = cut[order], of[order]
    new = np.append(True, (cut[1:] != cut[:-1]) | (of[1:] != of[:-1]))[: len(cut)]
    cut, of = cut[new], of[new]
    inner = of[1:] == of[:-1]
    lo, hi, pair = cut[:-1][inner], cut[1:][inner], of[:-1][inner]
    mid = (lo + hi) / 2
    slab_a, *left = _spans(s, a, pair, mid)
    slab_b, *right = _spans(s, b, pair, mid)
    n_b = np.bincount(slab_b, minlength=len(mid))
    j, i = ranges((np.cumsum(n_b) - n_b)[slab_a], n_b[slab_a])
    slab = slab_a[i]
    (alx, al, arx, ar), (blx, bl, brx, br) = (v[i] for v in left), (v[j] for v in right)
    lx, l_ = np.maximum(alx, blx), np.where(alx >= blx, al, bl)
    rx, r_ = np.minimum(arx, brx), np.where(arx <= brx, ar, br)
    keep = rx > lx
    slab = slab[keep]
    return pair[slab], lo[slab], hi[slab], l_[keep], r_[keep], (rx - lx)[keep] * (hi - lo)[slab]


def _in_parts(s: Sides, pieces, n):
    """Number of parts of each common area: pieces that share a stretch of a cut are of one part."""
    k, lo, hi, left, right, _ = pieces
    count = np.bincount(k, minlength=n)
    p, q, _ = crossed(*[np.cumsum(count) - count, count] * 2)
    y = hi[p]
    meet = (y == lo[q]) & (np.minimum(s.x_at(right[p], y), s.x_at(right[q], y)) > np.maximum(s.x_at(left[p], y), s.x_at(left[q], y)))
    label = list(range(len(k)))

    def top(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for i, j in zip(p[meet].tolist(), q[meet].tolist()):
        label[top(i)] = top(j)
    roots = [i for i in range(len(k)) if top(i) == i]
    return np.bincount(k[roots], minlength=n)


def _marks(r: Rooms, s: Sides, a, b, pieces, every_part):
    """(row, token) of the vertices nearest to the corners of the common area of rooms a[k] and b[k], in both rooms.

    The corners of an area are the vertices of both rooms and the crossings of their sides that lie on it, so
    lines that the rooms share elsewhere count for nothing. An area of several parts is marked part by part,
    or, without `every_part`, not at all.
    """
    marked = np.bincount(pieces[0], weights=pieces[5], minlength=len(a)) > 0
    if not every_part:
        marked &= _in_parts(s, pieces, len(a)) == 1
    hits = np.flatnonzero(marked)
    p, q, k = crossed(r.first[a[hits]], r.size[a[hits]], r.first[b[hits]], r.size[b[hits]])
    x1, y1, px, py = r.fx[p], r.fy[p], r.fx[r.after[p]] - r.fx[p], r.fy[r.after[p]] - r.fy[p]
    u1, v1, qx, qy = r.fx[q], r.fy[q], r.fx[r.after[q]] - r.fx[q], r.fy[r.after[q]] - r.fy[q]
    den = px * qy - py * qx
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = ((u1 - x1) * qy - (v1 - y1) * qx) / den, ((u1 - x1) * py - (v1 - y1) * px) / den
        cross = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        cx, cy = (x1 + t * px)[cross], (y1 + t * py)[cross]
    va, ka = ranges(r.first[a[hits]], r.size[a[hits]])
    vb, kb = ranges(r.first[b[hits]], r.size[b[hits]])
    x, y = np.concatenate([r.fx[va], r.fx[vb], cx]), np.concatenate([r.fy[va], r.fy[vb], cy])
    hit = hits[np.concatenate([ka, kb, k[cross]])]
    # Corners on a piece of their area.
    k, lo, hi, left, right, _ = pieces
    first = np.searchsorted(k, np.arange(len(a)))
    count = np.bincount(k, minlength=len(a))
    piece, of = ranges(first[hit], count[hit])
    cx, cy = x[of], y[of]
    inside = (
        (cy >= lo[piece] - 1e-9) & (cy <= hi[piece] + 1e-9)
        & (cx >= s.x_at(left[piece], cy) - 1e-9) & (cx <= s.x_at(right[piece], cy) + 1e-9)
    )
    on = np.unique(of[inside])
    x, y, hit = np.tile(x[on], 2), np.tile(y[on], 2), np.tile(hit[on], 2)
    room = np.where(np.arange(len(hit)) < len(on), a[hit], b[hit])
    vertex, of = ranges(r.first[room], r.size[room])
    far = (r.fx[vertex] - x[of]) ** 2 + (r.fy[vertex] - y[of]) ** 2
    order = np.lexsort((vertex, far, of))
    near = vertex[order][np.searchsorted(of, np.arange(len(hit)))]
    row, token = r.row[r.room[near]], r.idx[near]
    return np.concatenate([row, row]), np.concatenate([token, token + 1])


# --- doors ------------------------------------------------------------------------------------

def _reach(r: Rooms, doors: pa.Array):
    """For every valid door of a row the places of the rooms whose boundary is within reach."""
    _, length = lists_of(doors)
    door = doors.flatten().field("door")
    valid = door.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(doors)), length)[valid]
    x, y = (door.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)[valid] for k in "xy")
    side = np.flatnonzero(r.order[r.room] >= 0)
    of_row = r.row[r.room[side]]
    first = np.searchsorted(of_row, row)
    k, d = ranges(first, np.searchsorted(of_row, row, "right") - first)
    at = side[k]
    ax, ay = r.fx[at], r.fy[at]
    dx, dy = r.fx[r.after[at]] - ax, r.fy[r.after[at]] - ay
    long = dx * dx + dy * dy
    t = np.clip(((x[d] - ax) * dx + (y[d] - ay) * dy) / np.where(long > 0, long, 1), 0, 1)
    close = np.sqrt((x[d] - (ax + t * dx)) ** 2 + (y[d] - (ay + t * dy)) ** 2) <= DOOR_REACH
    of, room = distinct(d[close], r.order[r.room[at[close]]])
    rooms = pa.ListArray.from_arrays(offsets(of, len(row)), pa.array(room, pa.int32()))
    return pa.ListArray.from_arrays(offsets(row, len(doors)), rooms)


#: Fields of each part.
TYPES = {
    "angles": "n_angles:int;n_right:int;slanted:array<int>",
    "overlaps": "total:double;common:double",
    "marks": "marks:array<int>",
    "reach": "near:array<array<int>>",
}


def shape_fields(rooms: pa.Array, doors: pa.Array, parts: list[str], every_part: bool = True) -> dict[str, pa.Array]:
    """The fields of the wanted parts by name; see `shapes`."""
    r, n, made = Rooms(rooms), len(rooms), {}
    if "angles" in parts:
        at, right = _angles(r)
        row = r.row[r.room[at]]
        made["n_angles"] = pa.array(np.bincount(row, minlength=n), pa.int32())
        made["n_right"] = pa.array(np.bincount(row[right], minlength=n), pa.int32())
        tokens = np.stack([r.idx[at[~right]], r.idx[at[~right]] + 1], axis=1).ravel()
        made["slanted"] = pa.ListArray.from_arrays(offsets(np.repeat(row[~right], 2), n), pa.array(tokens, pa.int32()))
    if "overlaps" in parts or "marks" in parts:
        usable, area = _usable(r)
        a, b = _near(r, usable)
        s = Sides(r)
        common, marks = np.zeros(n), [(a[:0], a[:0])]
        for part in _batches(s.size[a] * s.size[b]):
            pieces = _pieces(s, a[part], b[part])
            common += np.bincount(r.row[a[part]][pieces[0]], weights=pieces[5], minlength=n)
            if "marks" in parts:
                marks.append(_marks(r, s, a[part], b[part], pieces, every_part))
        if "overlaps" in parts:
            made["total"] = pa.array(np.bincount(r.row[usable], weights=area, minlength=n))
            made["common"] = pa.array(common)
        if "marks" in parts:
            row, token = distinct(*(np.concatenate(v) for v in zip(*marks)))
            made["marks"] = pa.ListArray.from_arrays(offsets(row, n), pa.array(token, pa.int32()))
    if "reach" in parts:
        made["near"] = _reach(r, doors)
    return made


def shapes(rooms: Column, doors: Column, parts: list[str], every_part: bool = True) -> Column:
    """Struct of the wanted parts (names of `TYPES`) of a row's answered rooms and doors; null lists are empty.

    `n_angles`, `n_right`, `slanted`: angles, right ones, and the tokens of the vertices of the others. `total`,
    `common`: sum of the usable rooms' areas, and of the common areas of every two. `marks`: tokens of the vertices
    nearest to the corners of common areas. `near`: for every valid door the rooms in reach.
    """
    names = [f for p in TYPES if p in parts for f in TYPES[p].split(";")]

    def run(rooms: pa.Array, doors: pa.Array) -> pa.Array:
        made = shape_fields(rooms, doors, parts, every_part)
        own = [f.split(":")[0] for f in names]
        return pa.StructArray.from_arrays([made[f] for f in own], own)

    return F.arrow_udf(run, f"struct<{','.join(names)}>")(rooms, doors)


def _ring_distances(x: pa.Array, y: pa.Array, coords: pa.Array) -> pa.Array:
    start, length = lists_of(coords)
    corners = length // 2
    values = coords.flatten()
    there = values.is_valid().to_numpy(zero_copy_only=False)
    v = values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    i, of = ranges(np.zeros(len(coords), np.int64), corners)
    a, b = start[of] + 2 * i, start[of] + 2 * ((i + 1) % corners[of])
    px, py = (c.fill_null(0).to_numpy(zero_copy_only=False).astype(float)[of] for c in (x, y))
    dx, dy = v[b] - v[a], v[b + 1] - v[a + 1]
    square = dx * dx + dy * dy
    point = square < 1e-10
    t = np.where(point, 0, np.clip(((px - v[a]) * dx + (py - v[a + 1]) * dy) / np.where(point, 1, square), 0, 1))
    far = np.sqrt((px - (v[a] + t * dx)) ** 2 + (py - (v[a + 1] + t * dy)) ** 2)
    far[~(there[a] & there[a + 1] & there[b] & there[b + 1])] = np.inf
    least = np.full(len(coords), np.inf)
    np.minimum.at(least, of, far)
    known = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False) & np.isfinite(least)
    return pa.array(least, pa.float64(), mask=~known)


def ring_distance(x: Column, y: Column, coords: Column) -> Column:
    """Distance of a point to the boundary of a ring of flat coordinates (the inside is not zero); null without a side."""
    return F.arrow_udf(_ring_distances, "double")(x, y, coords)
