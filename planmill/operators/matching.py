"""Cheapest assignment between two small sets of places, in polynomial time, over Arrow batches."""

from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.constants import DIRECTIONS
from planmill.functions.flat import lists_of, offsets

#: Costs that differ by no more than this are equal.
TIE = 1e-9


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest full assignment of a square cost matrix; of equal ones the first.

    Rows are added one at a time along a shortest augmenting path over reduced costs, whose potentials stay
    valid from row to row. Every cheapest assignment uses pairs of reduced cost 0 only, so among those pairs
    each row in turn then takes the smallest column that leaves a full assignment for the rows after it.
    """
    n = len(cost)
    row_potential, column_potential = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        reach, last = np.full(n, np.inf), np.full(n, -1)
        open_ = np.ones(n, bool)
        row, column, total = start, -1, 0.0
        while row >= 0:
            through = total + cost[row] - row_potential[row] - column_potential
            shorter = open_ & (through < reach)
            reach[shorter], last[shorter] = through[shorter], column
            column = int(np.where(open_, reach, np.inf).argmin())
            total, open_[column] = reach[column], False
            row = owner[column]
        closed = ~open_
        row_potential[start] += total
        inner = closed & (owner >= 0)
        row_potential[owner[inner]] += total - reach[inner]
        column_potential[closed] -= total - reach[closed]
        while column >= 0:
            before = last[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    chosen = np.empty(n, np.int64)
    chosen[owner] = np.arange(n)
    tight = cost - row_potential[:, None] - column_potential <= TIE
    if tight.sum() > n:
        _first_of_equals(tight, chosen, owner)
    return chosen


def _first_of_equals(tight, chosen, owner):
    """Turn a full assignment within `tight` into the first one, row by row, in place."""
    n = len(tight)
    fixed = np.zeros(n, bool)
    for row in range(n):
        for column in np.flatnonzero(tight[row] & ~fixed).tolist():
            if column == chosen[row]:
                break
            # The row takes the column; its owner must come to the row's old column by way of later rows.
            path = _other_way(tight, owner, fixed, int(owner[column]), int(chosen[row]), column)
            if path is not None:
                owner[column], chosen[row] = row, column
                for r, c in path:
                    owner[c], chosen[r] = r, c
                break
        fixed[chosen[row]] = True


def _other_way(tight, owner, fixed, row, target, taken):
    """(row, column) changes that free `row` from its column without `taken`, ending in column `target`."""
    before, queue = {}, [row]
    seen = fixed.copy()
    seen[taken] = True
    for r in queue:
        for c in np.flatnonzero(tight[r] & ~seen).tolist():
            seen[c] = True
            before[c] = r
            if c == target:
                path = []
                while True:
                    r = before[c]
                    path.append((r, c))
                    if r == row:
                        return path
                    c = next(k for k, v in enumerate(owner) if v == r)
            queue.append(int(owner[c]))
    return None


def match_places(wanted, answered) -> list[tuple[int, int]]:
    """(index of a wanted place, index of its answered one) for (cx, cy) arrays; the smaller set is used up.

    Of equal assignments the first: wanted places in order, one without a partner before any, then the
    answered places in order.
    """
    e, a = len(wanted), len(answered)
    n = max(e, a)
    spare = max(e - a, 0)
    cost = np.zeros((n, n))
    distance = np.sqrt(((wanted[:, None] - answered[None]) ** 2).sum(axis=2))
    cost[:e, spare : spare + a] = distance
    if n == 1:
        return [(0, 0)]
    chosen = assign(cost)[:e]
    return [(i, int(c) - spare) for i, c in enumerate(chosen) if c >= spare]


def match_few(wanted, answered) -> list[tuple[int, int]] | None:
    """As `match_places` for at most two places on each side, lists of (cx, cy), without arrays; null where
    the two ways are so nearly equal that potentials have to tell whether they are."""
    e, a = len(wanted), len(answered)
    if e == a == 1:
        return [(0, 0)]
    d = [[sqrt((x - u) ** 2 + (y - v) ** 2) for u, v in answered] for x, y in wanted]
    if e == 1:
        straight, crossed = d[0]
        ways = [(0, 0)], [(0, 1)]
    elif a == 1:
        straight, crossed = d[1][0], d[0][0]
        ways = [(1, 0)], [(0, 0)]
    else:
        straight, crossed = d[0][0] + d[1][1], d[0][1] + d[1][0]
        ways = [(0, 0), (1, 1)], [(0, 1), (1, 0)]
    if TIE / 1000 < straight - crossed < TIE * 1000:
        return None
    return ways[0] if straight - crossed <= TIE else ways[1]


def _few_matches(wanted, answered, ins, outs, two_ins, two_outs):
    """As `match_few` for many groups at once: (groups, wanted place, answered place) of the pairs, and the groups left over.

    `ins` and `outs` are the places of each group's first wanted and answered room; the second, if there are two, comes next.
    """
    def far(i, o):
        return np.sqrt(((wanted[i] - answered[o]) ** 2).sum(axis=1))

    found, left = [], []
    for e2, a2 in ((False, False), (False, True), (True, False), (True, True)):
        k = np.flatnonzero((two_ins == e2) & (two_outs == a2))
        i, o = ins[k], outs[k]
        if not e2 and not a2:
            found.append((k, i, o))
            continue
        if not e2:
            straight, crossed = far(i, o), far(i, o + 1)
            ways = [(0, 0)], [(0, 1)]
        elif not a2:
            straight, crossed = far(i + 1, o), far(i, o)
            ways = [(1, 0)], [(0, 0)]
        else:
            straight, crossed = far(i, o) + far(i + 1, o + 1), far(i, o + 1) + far(i + 1, o)
            ways = [(0, 0), (1, 1)], [(0, 1), (1, 0)]
        more = straight - crossed
        near = (TIE / 1000 < more) & (more < TIE * 1000)
        left.append(k[near])
        for way, mine in zip(ways, (~near & (more <= TIE), ~near & (more > TIE)), strict=True):
            found += [(k[mine], i[mine] + p, o[mine] + q) for p, q in way]
    return [np.concatenate(c) for c in zip(*found, strict=True)], np.concatenate(left)


def _match_lists(wanted: pa.Array, answered: pa.Array) -> pa.Array:
    """For each row the (rid, out) pairs of both lists of (number, type, cx, cy), type by type."""
    known = (wanted.is_valid().to_numpy(zero_copy_only=False)) & (answered.is_valid().to_numpy(zero_copy_only=False))
    n = len(known)

    def columns(lists, number):
        flat = lists.flatten()
        place = np.stack([flat.field("cx").to_numpy(zero_copy_only=False), flat.field("cy").to_numpy(zero_copy_only=False)], axis=1)
        return flat.field(number), flat.field("type").cast(pa.string()), place, np.repeat(np.arange(n), lists_of(lists)[1])

    rids, in_types, in_places, in_row = columns(wanted, "rid")
    outs, out_types, out_places, out_row = columns(answered, "out")
    types = pa.concat_arrays([in_types, out_types]).dictionary_encode(null_encoding="encode")
    code = types.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    step = len(types.dictionary) + 1
    in_key, out_key = in_row * step + code[: len(in_row)], out_row * step + code[len(in_row) :]
    in_order, out_order = (np.argsort(k, kind="stable") for k in (in_key, out_key))
    key, first_in, n_in = np.unique(in_key[in_order], return_index=True, return_counts=True)
    first_out = np.searchsorted(out_key[out_order], key)
    n_out = np.searchsorted(out_key[out_order], key, "right") - first_out
    both = (n_out > 0) & known[key // step]
    first_in, n_in, first_out, n_out = first_in[both], n_in[both], first_out[both], n_out[both]
    in_places, out_places = in_places[in_order], out_places[out_order]

    few = np.flatnonzero((n_in <= 2) & (n_out <= 2))
    (k, i, o), left = _few_matches(in_places, out_places, first_in[few], first_out[few], n_in[few] == 2, n_out[few] == 2)
    group, pair_in, pair_out = [few[k]], [i], [o]
    rest = np.concatenate([np.flatnonzero((n_in > 2) | (n_out > 2)), few[left]])
    for g in rest.tolist():
        a, b = first_in[g], first_out[g]
        pairs = np.array(match_places(in_places[a : a + n_in[g]], out_places[b : b + n_out[g]]), np.int64).reshape(-1, 2)
        group.append(np.full(len(pairs), g))
        pair_in.append(pairs[:, 0] + a)
        pair_out.append(pairs[:, 1] + b)
    group, pair_in, pair_out = (np.concatenate(v).astype(np.int64) for v in (group, pair_in, pair_out))
    # Types by their first wanted room, then wanted rooms in order.
    lead, i, o = in_order[first_in[group]], in_order[pair_in], out_order[pair_out]
    order = np.lexsort((i, lead))
    i, o = i[order], o[order]
    pairs = pa.StructArray.from_arrays([v.take(pa.array(at)).cast(pa.int32()) for v, at in ((rids, i), (outs, o))], ["rid", "out"])
    return pa.ListArray.from_arrays(offsets(in_row[i], n), pairs, mask=pa.array(~known))


def matched(wanted: Column, answered: Column) -> Column:
    """array<struct<rid, out>>: within each type the assignment of wanted to answered rooms of least total distance.

    `wanted` holds structs (rid, type, cx, cy), `answered` structs (out, type, cx, cy). A null list gives null.
    """
    run = F.arrow_udf(_match_lists, "array<struct<rid:int,out:int>>")
    return run(wanted, answered)


def _share_of_relations(match: pa.Array, answered: pa.Array, relations: pa.Array) -> pa.Array:
    """For each row the share of relations whose matched rooms lie in their direction, as `geometry.direction_scored` has it."""
    def ints(values):
        return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False)

    n = len(match)
    _, n_match = lists_of(match)
    first_out, _ = lists_of(answered)
    _, n_rel = lists_of(relations)
    pairs, places, wanted = match.flatten(), answered.flatten(), relations.flatten()
    row = np.repeat(np.arange(n), n_rel)
    (a, has_a), (b, has_b) = (ints(wanted.field(f)) for f in ("rid_a", "rid_b"))
    rid, _ = ints(pairs.field("rid"))
    out, _ = ints(pairs.field("out"))
    place = first_out[np.repeat(np.arange(n), n_match)] + out

    least = min(v.min(initial=0) for v in (a, b, rid))
    span = max(v.max(initial=0) for v in (a, b, rid)) - least + 1
    keys = np.repeat(np.arange(n), n_match) * span + rid - least
    order = np.argsort(keys, kind="stable")
    keys, place = np.append(keys[order], -1), np.append(place[order], 0)

    def of(number):
        """Place of the room matched to a number in its row, and whether there is one."""
        key = row * span + number - least
        at = np.searchsorted(keys[:-1], key)
        return place[at], keys[at] == key

    (at_a, met_a), (at_b, met_b) = of(a), of(b)
    known = has_a & has_b
    met = np.flatnonzero(known & met_a & met_b)
    cx, cy = (places.field(f).to_numpy(zero_copy_only=False) for f in ("cx", "cy"))
    dx, dy = cx[at_b[met]] - cx[at_a[met]], cy[at_b[met]] - cy[at_a[met]]
    sector = np.floor((np.degrees(np.arctan2(dy, dx)) + 22.5) / 45).astype(np.int64) % 8
    seen = pc.equal(pa.array(DIRECTIONS).take(pa.array(sector)), wanted.field("direction").take(pa.array(met)).cast(pa.string()))
    right = pc.fill_null(seen, False).to_numpy(zero_copy_only=False) & ~((np.abs(dx) < 1e-9) & (np.abs(dy) < 1e-9))
    n_known, n_right = np.bincount(row[known], minlength=n), np.bincount(row[met[right]], minlength=n)
    given = relations.is_valid().to_numpy(zero_copy_only=False)
    share = np.where(n_known > 0, n_right / np.maximum(n_known, 1), 1.0)
    share = np.where(given & (n_rel == 0), 1.0, np.where(n_match == 0, 0.0, share))
    return pa.array(share, mask=~given & (n_match > 0))


def share_of_relations(match: Column, answered: Column, relations: Column) -> Column:
    """Share of `relations` (rid_a, rid_b, direction) in whose direction the matched ones of `answered` lie, made in Arrow batches.

    A relation with an unknown end does not count, one with an unmatched end is missed. Without relations the share
    is 1, without matches 0.
    """
    return F.arrow_udf(_share_of_relations, "double")(match, answered, relations)
