"""Answer token sequences made in Arrow batches: all sequences of a batch are laid out together.

A sequence is a row of pieces (front door, rooms, doors), whose lengths are known before any token is made; so each
token's place in the batch is known, and all tokens of a kind are put down at once as numbers in a list of words.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.constants import OUTLINE
from planmill.functions.flat import lists_of, ranges, ring_means

_WORDS = [
    "<OUTPUT>", "<END_OUTPUT>", "<FRONT_DOOR>", "<NO_DOOR>", "<SEP_DOOR>", "<END_DOOR>", "<DOOR>", "<ROOM>", "<END_ROOM>",
]
OUTPUT, END_OUTPUT, FRONT_DOOR, NO_DOOR, SEP_DOOR, END_DOOR, DOOR, ROOM, END_ROOM = range(len(_WORDS))
#: Numbers that lie no further apart than this have a word each; others are looked up.
SPAN = 1 << 16
_NO_WORD = -1


class Words:
    """The words of a batch: fixed ones first, then those of numbers and types, as they are asked for."""

    def __init__(self):
        self.parts, self.n = [pa.array(_WORDS, pa.string())], len(_WORDS)

    def _add(self, words) -> int:
        self.parts.append(words)
        self.n += len(words)
        return self.n - len(words)

    def numbered(self, kind: str, values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Places of the words <kind:value>; none where a value is not known."""
        out = np.full(len(values), _NO_WORD)
        held = values[known]
        if len(held):
            low, high = int(held.min()), int(held.max())
            own, at = (np.arange(low, high + 1), held - low) if high - low < SPAN else np.unique(held, return_inverse=True)
            text = pc.cast(pa.array(own), pa.string())
            out[known] = at + self._add(pc.binary_join_element_wise(f"<{kind}:", text, ">", ""))
        return out

    def typed(self, types: pa.Array) -> np.ndarray:
        coded = types.dictionary_encode()
        first = self._add(pc.binary_join_element_wise("<TYPE:", coded.dictionary.cast(pa.string()), ">", ""))
        return coded.indices.fill_null(_NO_WORD - first).to_numpy(zero_copy_only=False).astype(np.int64) + first

    def take(self, places: np.ndarray) -> pa.Array:
        return pa.concat_arrays(self.parts).take(pa.array(places, pa.int32(), mask=places < 0))


def _ints(values: pa.Array):
    """(numbers, which are known)."""
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False)


def _rounded(values: pa.Array):
    """(half-to-even integers, which are known), as every number of a door is written."""
    plain = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if not (np.abs(plain) < 2**31).all():
        raise ValueError("a door's number is no int")
    return np.rint(plain).astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False)


def _valid(values: pa.Array) -> np.ndarray:
    return values.is_valid().to_numpy(zero_copy_only=False)


class Rooms:
    """The rooms of a batch in the order of an answer: the first outline, then rooms by mean y, mean x and place."""

    def __init__(self, lists: pa.Array, changed: np.ndarray, moved: np.ndarray, fewer: np.ndarray):
        """`changed`: number of the room that is moved by 20, in rows that are `moved`; rows of `fewer` leave their last room out."""
        n = len(lists)
        _, length = lists_of(lists)
        flat = lists.flatten()
        row = np.repeat(np.arange(n), length)
        rid, numbered = _ints(flat.field("rid"))
        rings = flat.field("coords")
        first, size = lists_of(rings)
        values, there = _ints(rings.flatten())
        at, room = ranges(np.zeros(len(first), np.int64), size)
        shifted = moved[row] & numbered & (rid == changed[row])
        values = np.where(shifted[room] & (at % 2 == 0), values + 20, values)

        types = flat.field("type")
        outline = pc.fill_null(pc.equal(types, OUTLINE), False).to_numpy(zero_copy_only=False)
        there_too = ~fewer[row] | (numbered & (rid < length[row] - 1))
        kept = _valid(flat) & _valid(types) & there_too
        # A room without a mean comes first.
        mean_x, mean_y, _ = ring_means(rings, np.where(shifted, 20, 0))
        # Of the outlines only the first, before all rooms.
        lead = np.flatnonzero(outline & kept)
        lead = lead[np.append(True, row[lead][1:] != row[lead][:-1])[: len(lead)]]
        rest = np.flatnonzero(~outline & kept)
        rest = rest[np.lexsort((rest, mean_x[rest], mean_y[rest], row[rest]))]
        both = np.concatenate([lead, rest])
        self.order = both[np.argsort(row[both], kind="stable")]
        self.row = row[self.order]
        self.size = size[self.order]
        self.first = first[self.order]
        self.types, self.values, self.there = types, values, there
        broken = kept & ~_valid(rings)
        self.broken = np.bincount(row[broken], minlength=n) > 0


def _doors(lists: pa.Array):
    """(row of each edge, number of doors of each, edge of each door, door structs, rows with an edge that has no list)."""
    n = len(lists)
    _, length = lists_of(lists)
    row = np.repeat(np.arange(n), length)
    doors = lists.flatten().field("door")
    _, count = lists_of(doors)
    broken = np.bincount(row[~_valid(doors)], minlength=n) > 0
    return row, count, np.repeat(np.arange(len(count)), count), doors.flatten(), broken


def _laid_out(kind: pa.Array, even: pa.Array, changed: pa.Array, rooms: pa.Array, edges: pa.Array, front: pa.Array) -> pa.Array:
    n = len(rooms)
    gen, _ = _ints(kind)
    moved_room, moves = _ints(changed)
    r = Rooms(rooms, moved_room, (gen == 1) & moves, gen == 2)
    edge_row, n_doors, edge, doors, no_doors = _doors(edges)
    begin, n_front = lists_of(front)
    # An unknown list of front doors is one door of unknown numbers.
    hold = np.where(_valid(front), n_front, 1) > 0

    room_length = 3 + r.size
    edge_length = np.where(n_doors == 0, 1, 7 * n_doors)
    front_length = np.where(hold, 7, 3)
    in_rooms = np.bincount(r.row, weights=room_length, minlength=n).astype(np.int64)
    in_edges = np.bincount(edge_row, weights=edge_length, minlength=n).astype(np.int64)
    length = 2 + front_length + in_rooms + in_edges
    start = np.cumsum(length) - length
    words, total = Words(), int(length.sum())
    codes = np.full(total, _NO_WORD)
    codes[start] = OUTPUT
    codes[start + length - 1] = END_OUTPUT

    def put_door(at, opening, x, y, w, h):
        codes[at], codes[at + 3], codes[at + 6] = opening, SEP_DOOR, END_DOOR
        for k, v in zip((1, 2, 4, 5), (x, y, w, h), strict=True):
            codes[at + k] = v

    at = start + 1
    codes[at[~hold]], codes[at[~hold] + 1], codes[at[~hold] + 2] = FRONT_DOOR, NO_DOOR, END_DOOR
    given = hold & (n_front > 0)
    own = front.flatten().take(pa.array(begin[given]))
    four = []
    for f, letter in zip("xywh", "XYXY", strict=True):
        column = np.full(n, _NO_WORD)
        column[given] = words.numbered(letter, *_rounded(own.field(f)))
        four.append(column[hold])
    put_door(at[hold], FRONT_DOOR, *four)

    def starts(owner, sizes, first):
        """Places of the pieces of rows, one after the other from `first` of the row."""
        so_far = np.cumsum(sizes) - sizes
        lead = np.searchsorted(owner, np.arange(n))
        return so_far - np.append(so_far, 0)[lead][owner] + first[owner]

    at = starts(r.row, room_length, start + 1 + front_length)
    first_room_end = np.full(n, -1)
    first_room_end[r.row[::-1]] = (at + room_length - 1)[::-1]
    codes[at], codes[at + room_length - 1] = ROOM, END_ROOM
    codes[at + 1] = words.typed(r.types)[r.order]
    k, room = ranges(np.zeros(len(at), np.int64), r.size)
    value, even_place = r.first[room] + k, k % 2 == 0
    for letter, mine in (("X", even_place), ("Y", ~even_place)):
        codes[(at[room] + 2 + k)[mine]] = words.numbered(letter, r.values[value[mine]], r.there[value[mine]])

    at = starts(edge_row, edge_length, start + 1 + front_length + in_rooms)
    codes[at[n_doors == 0]] = NO_DOOR
    nth = np.arange(len(edge)) - (np.cumsum(n_doors) - n_doors)[edge]
    put_door(
        at[edge] + 7 * nth, DOOR, *(words.numbered(letter, *_rounded(doors.field(f))) for f, letter in zip("xywh", "XYXY", strict=True))
    )

    known = _valid(rooms) & _valid(edges) & ~r.broken & ~no_doors
    broken = np.flatnonzero((gen == 3) & known)
    without = pc.fill_null(even, False).to_numpy(zero_copy_only=False)[broken]
    gone = first_room_end[broken[without]]
    table = pa.concat_arrays(words.parts)
    is_x = np.append(pc.starts_with(table, "<X:").to_numpy(zero_copy_only=False), False)
    x_at = np.flatnonzero(is_x[codes])
    row = broken[~without]
    first = np.append(x_at, total)[np.searchsorted(x_at, start[row])]
    if (gone < 0).any() or (first >= start[row] + length[row]).any():
        raise ValueError("an answer without a room cannot be broken")
    codes[first], codes[first + 1] = codes[first + 1], codes[first]
    left = np.ones(total, bool)
    left[gone] = False
    length[broken[without]] -= 1
    left &= np.repeat(known, np.diff(np.append(start, total)))
    length[~known] = 0
    ends = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
    codes = codes[left]
    tokens = table.take(pa.array(codes, pa.int32(), mask=codes < 0))
    return pa.ListArray.from_arrays(ends, tokens, mask=pa.array(~known))


def answer_of(kind: Column, even: Column, changed: Column, rooms: Column, edges: Column, front_door: Column) -> Column:
    """The answer's token list by its kind: 0 whole, 1 with the room numbered `changed` moved by 20 in x, 2 without the room of
    the highest number, 3 without its first <END_ROOM> where `even`, else with its first x and the token after it changed about.

    Front door, first outline, rooms by mean y, mean x and place, doors of the edges in the order given. Null where rooms, edges,
    or one of their lists is; a number that is null is a null token, a place that is null comes first, as in `tokenize`.
    """
    return F.arrow_udf(_laid_out, "array<string>")(kind, even, changed, rooms, edges, front_door)
