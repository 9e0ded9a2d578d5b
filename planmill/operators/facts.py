"""What the scores of an answer need to know, made in one pass over Arrow batches.

Geometry, matching and the comparison with the plan's edges, relations and counts read the same lists of rooms; in a
pass of their own each, whole rows would wait and be copied once a score.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.constants import OUTLINE
from planmill.functions.flat import crossed, first_places, group_sums, lists_of, offsets, ring_means
from planmill.operators.matching import _match_lists, _share_of_relations
from planmill.operators.shapes import TYPES as SHAPES
from planmill.operators.shapes import shape_fields

#: Part -> (fields, lists that are read besides the answered rooms).
PARTS = {
    **{p: (fields, ["doors"] if p == "reach" else []) for p, fields in SHAPES.items()},
    "outs": ("n_out:int", []),
    "types": ("type_share:double", ["counts"]),
    "match": ("match:array<struct<rid:int,out:int>>", ["wanted"]),
    "related": ("related:double", ["wanted", "spatial"]),
    "connected": ("connected:double", ["wanted", "doors", "edges"]),
}


def _valid(values):
    return values.is_valid().to_numpy(zero_copy_only=False)


def _numbers(values):
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rooms(lists, number, first, means):
    """List array of (number, type, cx, cy) of the rooms that are no outline; a mean that there is not is 0."""
    n = len(lists)
    _, length = lists_of(lists)
    row = np.repeat(np.arange(n), length)
    flat = lists.flatten()
    kept = np.flatnonzero(pc.fill_null(pc.not_equal(flat.field("type"), OUTLINE), False).to_numpy(zero_copy_only=False))
    own = offsets(row[kept], n)
    values = first(flat, row[kept], own.to_numpy()).take(pa.array(kept)) if number == "rid" else first(flat, row[kept], own.to_numpy())
    cx, cy = (pa.array(np.where(np.isfinite(m), m, 0)[kept]) for m in means(flat))
    places = pa.StructArray.from_arrays([values, flat.field("type").take(pa.array(kept)), cx, cy], [number, "type", "cx", "cy"])
    return pa.ListArray.from_arrays(own, places, mask=pa.array(~_valid(lists)))


def _answered(lists):
    def means(flat):
        points = flat.field("points")
        size = lists_of(points)[1]
        corners = points.flatten()
        return [group_sums(_numbers(corners.field(k)), size) / np.maximum(size, 1) for k in "xy"]

    return _rooms(lists, "out", lambda flat, row, begin: pa.array(np.arange(len(row)) - begin[row], pa.int32()), means)


def _wanted(lists):
    return _rooms(lists, "rid", lambda flat, row, begin: flat.field("rid"), lambda flat: ring_means(flat.field("coords"))[:2])


def _connected(match, near, edges):
    """Share of a plan's edges with a door whose matched rooms are both in reach of one answered door."""
    n = len(match)
    _, n_match = lists_of(match)
    of = np.repeat(np.arange(n), n_match)
    pairs = match.flatten()
    rid, out = _numbers(pairs.field("rid")), _numbers(pairs.field("out"))
    _, n_edges = lists_of(edges)
    row = np.repeat(np.arange(n), n_edges)
    flat = edges.flatten()
    doored = lists_of(flat.field("door"))[1] > 0
    begin, size = lists_of(flat.field("pair"))
    ends = flat.field("pair").flatten()
    number, there = _numbers(ends), _valid(ends)
    asked = np.flatnonzero(doored & (size >= 2))
    a, b = begin[asked], begin[asked] + 1
    asked, a, b = (v[there[a] & there[b]] for v in (asked, a, b))
    least = min(number.min(initial=0), rid.min(initial=0))
    span = max(number.max(initial=0), rid.max(initial=0)) - least + 1
    keys = of * span + rid - least
    # A number without a valid room has no match.
    keys = np.where(_valid(pairs.field("rid")), keys, -1)
    at_a, at_b = (first_places(keys, row[asked] * span + number[e] - least) for e in (a, b))
    met = (at_a >= 0) & (at_b >= 0)
    asked, out_a, out_b = asked[met], out[at_a[met]], out[at_b[met]]

    _, n_doors = lists_of(near)
    reached = near.flatten()
    first, count = lists_of(reached)
    rooms = _numbers(reached.flatten())
    p, q, door = crossed(first, count, first, count)
    step = max(rooms.max(initial=0), out.max(initial=0)) + 1
    of_door = np.repeat(np.arange(n), n_doors)
    both = (of_door[door] * step + rooms[p]) * step + rooms[q]
    linked = np.isin((row[asked] * step + out_a) * step + out_b, both)
    n_doored = np.bincount(row[doored], minlength=n)
    share = np.bincount(row[asked[linked]], minlength=n) / np.maximum(n_doored, 1)
    given = _valid(edges)
    share = np.where(given & (n_edges == 0), 1.0, np.where(n_match == 0, 0.0, np.where(n_doored == 0, 1.0, share)))
    return pa.array(share, mask=~given & (n_match > 0))


def _type_share(answered, counts):
    """Mean over the wanted types, and over those that were not asked for, of how near the number of rooms is to the wanted one."""
    n = len(answered)
    types = answered.flatten().field("type").cast(pa.string())
    row = np.repeat(np.arange(n), lists_of(answered)[1])
    _, n_types = lists_of(counts)
    flat = counts.flatten()
    coded = pa.concat_arrays([types, flat.field("key").cast(pa.string())]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    step = len(coded.dictionary) + 1
    of = np.repeat(np.arange(n), n_types)
    asked = of * step + code[len(types) :]
    got, times = np.unique(row * step + code[: len(types)], return_counts=True)
    at = np.minimum(np.searchsorted(got, asked), max(len(got) - 1, 0))
    have = np.where(got[at] == asked, times[at], 0) if len(got) else np.zeros(len(asked))
    want = _numbers(flat.field("value"))
    near = np.where(_valid(flat.field("value")), np.maximum(0, 1 - np.abs(have - want) / np.maximum(want, 1)), 0)
    extra = np.bincount(got[~np.isin(got, asked)] // step, minlength=n)
    share = np.bincount(of, weights=near, minlength=n) / np.maximum(n_types + extra, 1)
    given = _valid(counts)
    return pa.array(np.where(n_types == 0, 1.0, share), mask=~given)


def facts(parts: list[str], every_part: bool = True, **lists: Column) -> Column:
    """Struct of the fields of the wanted parts (names of `PARTS`), from lists `rooms`, `doors`, `wanted`, `edges`, `spatial`, `counts`.

    `rooms` and `doors` are parsed ones, `wanted`, `edges` and `spatial` those of the plan, `counts` has (key, value) of its
    types. For `shapes` parts see there. `n_out`: answered rooms without outlines. `match`: see `matched`. `related`: see
    `share_of_relations`. `connected`: share of the wanted edges with doors whose two matched rooms are in reach of one door.
    """
    read = list(dict.fromkeys(["rooms", *(c for p in parts for c in PARTS[p][1])]))
    kind = [tuple(f.split(":", 1)) for p in PARTS if p in parts for f in PARTS[p][0].split(";")]
    shaped = [p for p in SHAPES if p in parts or (p == "reach" and "connected" in parts)]

    def run(*arrays: pa.Array) -> pa.Array:
        own = dict(zip(read, arrays, strict=True))
        made = shape_fields(own["rooms"], own.get("doors"), shaped, every_part) if shaped else {}
        if set(parts) - set(SHAPES):
            answered = _answered(own["rooms"])
            made["n_out"] = pa.array(lists_of(answered)[1], pa.int32())
            if "types" in parts:
                made["type_share"] = _type_share(answered, own["counts"])
            if "wanted" in read:
                made["match"] = _match_lists(_wanted(own["wanted"]), answered)
            if "related" in parts:
                made["related"] = _share_of_relations(made["match"], answered, own["spatial"])
            if "connected" in parts:
                made["connected"] = _connected(made["match"], made["near"], own["edges"])
        return pa.StructArray.from_arrays([made[f] for f, _ in kind], [f for f, _ in kind])

    fields = ",".join(f"{f}:{t}" for f, t in kind)
    return F.arrow_udf(run, f"struct<{fields}>")(*(lists[c] for c in read))
