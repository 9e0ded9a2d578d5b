"""Geometry on flat coordinate arrays, as SQL expression text (JVM-side, no Python)."""

from planmill.constants import DIRECTIONS


def xs(coords):
    return f"filter({coords}, (v, i) -> i % 2 = 0)"


def ys(coords):
    return f"filter({coords}, (v, i) -> i % 2 = 1)"


def mean(values):
    """Mean of an int array; null when empty."""
    return (
        f"(aggregate({values}, 0L, (s, v) -> s + v) / "
        f"nullif(cast(size({values}) as double), 0D))"
    )


def vertices(coords):
    """Flat [x1,y1,...] -> array of (x, y) structs; a dangling last value is ignored."""
    return (
        f"transform(filter(sequence(0, size({coords})), k -> k < size({coords}) div 2), "
        f"k -> named_struct('x', {coords}[2*k], 'y', {coords}[2*k+1]))"
    )


def flatten_vertices(points):
    return f"flatten(transform({points}, p -> array(p.x, p.y)))"


def rotate(array, start):
    """Rotate an array so that the 0-based `start` element comes first."""
    return f"concat(slice({array}, {start} + 1, size({array})), slice({array}, 1, {start}))"


def swap_words(text, a, b):
    return f"replace(replace(replace({text}, '{a}', '#'), '{b}', '{a}'), '#', '{b}')"


def mirror_h(direction):
    """Direction seen after an x mirror."""
    return swap_words(direction, "left", "right")


def mirror_v(direction):
    """Direction seen after a y mirror."""
    return swap_words(direction, "above", "below")


def opposite(direction):
    return mirror_v(mirror_h(direction))


def direction_built(dx, dy):
    """Eight-way direction, bins (low, high]; a zero vector is 'right'."""
    return _name(f"ceil((degrees(atan2({dy}, {dx})) - 22.5D) / 45D)")


def direction_scored(dx, dy):
    """Eight-way direction, bins [low, high); a zero vector has none (null)."""
    return (
        f"if(abs({dx}) < 1e-9 and abs({dy}) < 1e-9, cast(null as string), "
        + _name(f"floor((degrees(atan2({dy}, {dx})) + 22.5D) / 45D)")
        + ")"
    )


def _name(sector):
    names = ", ".join(f"'{d}'" for d in DIRECTIONS)
    return f"array({names})[cast(pmod({sector}, 8) as int)]"


def shoelace(points):
    """Twice the signed area of a ring of (x, y) structs."""
    return (
        f"aggregate(transform({points}, (p, i) -> "
        f"p.x * {points}[(i + 1) % size({points})].y - {points}[(i + 1) % size({points})].x * p.y), "
        f"0D, (s, v) -> s + v)"
    )


def point_segment_distance(px, py, ax, ay, bx, by):
    """Distance of a point to a segment; a segment shorter than 1e-5 counts as its first end."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"greatest(0D, least(1D, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / nullif({len2}, 0D)))"
    return (
        f"case when {len2} < 1e-10 then sqrt(pow({px} - {ax}, 2) + pow({py} - {ay}, 2)) "
        f"else sqrt(pow({px} - ({ax} + {t} * {dx}), 2) + pow({py} - ({ay} + {t} * {dy}), 2)) end"
    )


def point_ring_distance(px, py, points):
    """Distance of a point to the boundary of a ring (the inside is not zero)."""
    nxt = f"{points}[(i + 1) % size({points})]"
    seg = point_segment_distance(
        f"cast({px} as double)", f"cast({py} as double)",
        "cast(p.x as double)", "cast(p.y as double)",
        f"cast({nxt}.x as double)", f"cast({nxt}.y as double)",
    )
    return f"array_min(transform({points}, (p, i) -> {seg}))"
