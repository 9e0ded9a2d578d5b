"""The strict answer grammar over Arrow batches: all sequences of a batch are read together.

Each distinct token is looked at once, for its class letter and its number. The letters of a batch are one text,
a line a sequence, in which regular expressions find the blocks, or, in lines without a fault in their blocks, their
first letters alone, of all lines at once; rules about single tokens are comparisons of that text with itself, shifted.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.functions.flat import offsets, ranges

#: Letters of the token classes; numbered tokens have theirs by prefix.
LETTERS = {
    "<ROOM>": "R", "<END_ROOM>": "r", "<DOOR>": "D", "<END_DOOR>": "d", "<SEP_DOOR>": "s",
    "<NO_DOOR>": "n", "<FRONT_DOOR>": "F", "<OUTPUT>": "O", "<END_OUTPUT>": "E", "<EOS>": "e",
    "<EDGE>": "G", "<END_EDGE>": "g", "<SP>": "P", "<END_SP>": "p",
    "<ROOM_SUMMARY>": "S", "<END_ROOM_SUMMARY>": "z", "<INPUT>": "I", "<END_INPUT>": "J",
}
PREFIXES = {"<TYPE:": "t", "<RID:": "i", "<REL:": "l"}

PAIR = "struct<x:int,y:int>"
DOOR = "struct<x:int,y:int,w:int,h:int>"
PARSED = (
    f"struct<level:int,success:boolean,front_door:{DOOR},rooms:array<struct<type:string,points:array<{PAIR}>,"
    f"idx:array<int>,block_start:int,block_end:int>>,doors:array<struct<door:{DOOR}>>,errors:array<int>>"
)

_ROOM = rb"R(?:t[^RrDdnEF\n]*|(?:[^tr\n][^r\n]*)?)r?"
_DOOR = rb"x?y?s?x?y?d?"
_ROOMS = re.compile(_ROOM)
_BLOCKS = re.compile(rb"D" + _DOOR + rb"|n|[^Dn]")
_ANSWER = re.compile(rb"[^O\n]*O((?:F(?:nd?|" + _DOOR + rb"))?)((?:" + _ROOM + rb")*+)([^Ee\n]*)")
_NUMBER = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*")


def number(text: str) -> int | None:
    """The int that a cast of the text gives."""
    found = _NUMBER.fullmatch(text)
    value = int(found[1]) if found else None
    return value if value is not None and -(2**31) <= value < 2**31 else None


def classify(token: str | None) -> tuple[str, int]:
    """Class letter and number of a token; the number is 0 unless the letter is x or y."""
    if token is None:
        return "?", 0
    if token.startswith(("<X:", "<Y:")):
        value = number(token[3:-1])
        return ("?", 0) if value is None else (token[1].lower(), value)
    for prefix, letter in PREFIXES.items():
        if token.startswith(prefix):
            return letter, 0
    return LETTERS.get(token, "?"), 0


class Tokens:
    """A batch of token lists: `text` of letters with a line a sequence, and at the same places `values` and `words`
    (numbers in `names`). `start` and `length` are the place and number of letters of each line."""

    def __init__(self, lists: pa.Array):
        self.length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        self.names = [None if w is None else w.decode(errors="replace") for w in words]
        known = [classify(t) for t in self.names]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1]
        total = int(self.length.sum() + len(self.length))
        place = np.ones(total, bool)
        place[self.start + self.length] = False
        letters = np.full(total, ord("\n"), np.uint8)
        letters[place] = np.frombuffer("".join(c for c, _ in known).encode(), np.uint8)[codes]
        # Looks at the neighbour of the last letter need one more.
        self.letters = np.append(letters, np.uint8(ord("\n")))
        self.values, self.words = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.values[place] = np.array([v for _, v in known], np.int32)[codes]
        self.words[place] = codes
        self.text = letters.tobytes()


def _ints(values):
    return pa.array(values, pa.int32())


def _struct(mask=None, **fields):
    return pa.StructArray.from_arrays(list(fields.values()), list(fields), mask=mask)


def _doors(tokens, at, end):
    """Door blocks at `at` up to `end`, with an opening letter: (places of errors, struct array of doors)."""
    c, n = tokens.letters, end - at
    inner = lambda k: np.where(k < n, c[np.minimum(at + k, len(c) - 1)], 0)
    is_x, is_y = inner(1) == ord("x"), inner(1) == ord("y")
    lead = np.where(is_x & (inner(2) == ord("y")), 2, np.where(is_x | is_y, 1, 0))
    split = np.zeros(len(at), bool)
    for k in range(1, 4):
        split |= inner(k) == ord("s")
    closed = (n > 1) & (c[end - 1] == ord("d"))
    errors = np.concatenate([(at + 1 + lead)[~split], end[~closed]])
    gap = split.astype(np.int64)
    whole = (lead == 2) & (n - closed == 5 + gap)
    v = lambda k: _ints(np.where(whole, tokens.values[np.minimum(at + k, len(tokens.values) - 1)], 0) if len(at) else [])
    return errors, _struct(pa.array(~whole), x=v(1), y=v(2), w=v(3 + gap), h=v(4 + gap))


def _one_of(letters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(letters)] = True
    return table


_ROOM_ENDS, _ANSWER_ENDS = _one_of(b"RrDdnEF\n"), _one_of(b"Ee\n")


def _spelled(c, at, word: bytes):
    """Whether the letters at each place are those of the word."""
    out = np.ones(len(at), bool)
    for k, letter in enumerate(word):
        out &= c[np.minimum(at + k, len(c) - 1)] == letter
    return out


def _plain(tokens: Tokens):
    """Lines in which all blocks can be told by their first letters: (which, tables (line, place, end) of fronts, rooms and doors).

    Their front door is left out, empty or whole, every room has a type and begins where the one before ended, and what
    follows are whole doors and single <NO_DOOR>. Blocks are then those that the regular expressions find.
    """
    c, start = tokens.letters, tokens.start
    next_of = lambda places, at: np.append(places, len(c))[np.searchsorted(places, at)]
    line_of = lambda at: np.searchsorted(start, at, "right") - 1
    o = next_of(np.flatnonzero(c == ord("O")), start)
    good = o < start + tokens.length
    front = np.where(good, o, start) + 1
    none, whole = _spelled(c, front, b"Fnd"), _spelled(c, front, b"Fxysxyd")
    good &= (c[np.minimum(front, len(c) - 1)] != ord("F")) | none | whole
    begin = front + np.where(none, 3, np.where(whole, 7, 0))

    room = np.flatnonzero(c == ord("R"))
    line = line_of(room)
    end = np.minimum(next_of(np.flatnonzero(_ROOM_ENDS[c]), room + 2), len(c) - 1)
    end = end + (c[end] == ord("r"))
    new = np.append(True, line[1:] != line[:-1])[: len(line)]
    due = np.where(new, begin[line], np.append(0, end[:-1])[: len(line)])
    good[line[(c[room + 1] != ord("t")) | (room != due)]] = False
    last = np.append(new[1:], True)[: len(line)]
    tail = begin.copy()
    tail[line[last]] = end[last]

    stop = next_of(np.flatnonzero(_ANSWER_ENDS[c]), tail)
    in_tail = lambda at, of: (at >= tail[of]) & (at < stop[of])
    door, none_at = (np.flatnonzero(c == ord(k)) for k in "Dn")
    of, none_of = line_of(door), line_of(np.minimum(none_at, len(c) - 2))
    held = in_tail(door, of)
    door, of = door[held], of[held]
    n_none = np.bincount(none_of[in_tail(none_at, none_of)], minlength=len(start))
    good[of[~_spelled(c, door, b"Dxysxyd")]] = False
    good &= stop - tail == 7 * np.bincount(of, minlength=len(start)) + n_none
    mine = np.flatnonzero(good & whole)
    kept = lambda line, at, end: np.stack([line, at, end])[:, good[line]]
    return good, kept(mine, front[mine], front[mine] + 7), kept(line, room, end), kept(of, door, door + 7)


def _read(lists: pa.Array) -> pa.Array:
    tokens = Tokens(lists)
    text, c, n = tokens.text, tokens.letters, len(lists)
    seen, *plain = _plain(tokens) if n else (np.zeros(0, bool), *[np.zeros((3, 0), np.int64)] * 3)
    fronts, rooms, doors = [], [], []
    for k in np.flatnonzero(~seen).tolist():
        found = _ANSWER.match(text, int(tokens.start[k]))
        if not found:
            continue
        seen[k] = True
        (a, b), (_, z), (_, end) = found.regs[1:]
        if b > a and c[a + 1] != ord("n"):
            fronts.append((k, a, b))
        rooms += [(k, *m.span()) for m in _ROOMS.finditer(text, b, z)]
        doors += [(k, *m.span()) for m in _BLOCKS.finditer(text, z, end)]

    def table(rows, others):
        both = np.concatenate([np.array(rows, np.int64).reshape(-1, 3).T, others], axis=1)
        return both[:, np.argsort(both[1], kind="stable")]

    start = tokens.start

    # Rooms: a vertex is an x letter directly followed by a y letter inside the block.
    row, at, end = table(rooms, plain[1])
    typed = c[at + 1] == ord("t")
    bad = [at[~typed]]
    row, at, end = row[typed], at[typed], end[typed]
    shut = c[end - 1] == ord("r")
    last = end - np.where(shut, 2, 1)
    p, room = ranges(at + 2, np.maximum(last - at - 1, 0))
    pair = (c[p] == ord("x")) & (p < last[room]) & (c[p + 1] == ord("y"))
    stray = np.where(c[p] == ord("y"), c[p - 1] != ord("x"), ~pair)
    bad += [p[stray], end[~shut]]
    vertex, of = p[pair], room[pair]
    short = np.bincount(of, minlength=len(at)) < 4
    bad.append(ranges(at[short], (end - at)[short])[0])
    corners = offsets(of, len(at))
    own = np.unique(tokens.words[at + 1], return_inverse=True)
    names = pa.array([tokens.names[w][6:-1] for w in own[0]], pa.string())
    listed = pa.ListArray.from_arrays(offsets(row, n), _struct(
        type=names.take(pa.array(own[1], pa.int32())),
        points=pa.ListArray.from_arrays(corners, _struct(x=_ints(tokens.values[vertex]), y=_ints(tokens.values[vertex + 1]))),
        idx=pa.ListArray.from_arrays(corners, _ints(vertex - start[row][of])),
        block_start=_ints(at - start[row]),
        block_end=_ints(end - start[row] - shut),
    ))
    n_rooms = np.bincount(row, minlength=n)

    row, at, end = table(doors, plain[2])
    opens = c[at] == ord("D")
    bad.append(at[~opens & (c[at] != ord("n"))])
    missing, values = _doors(tokens, at[opens], end[opens])
    bad.append(missing)
    answered = pa.ListArray.from_arrays(offsets(row[opens], n), _struct(door=values))

    row, at, end = table(fronts, plain[0])
    missing, values = _doors(tokens, at, end)
    bad.append(missing)
    of_row = np.full(n, -1)
    of_row[row] = np.arange(len(row))
    front = values.take(pa.array(of_row, pa.int32(), mask=of_row < 0))

    # A missing closing token is marked at the next place, which is the line's end where the sequence ends.
    bad.append(ranges(start[~seen], tokens.length[~seen])[0])
    wrong = np.unique(np.concatenate(bad))
    row = np.searchsorted(start, wrong, "right") - 1
    n_wrong = np.bincount(row, minlength=n)
    level = np.where(~seen, 0, np.where(n_rooms == 0, 1, np.where(n_wrong > 0, 2, 3)))
    return _struct(
        pa.array(~lists.is_valid().to_numpy(zero_copy_only=False)),
        level=_ints(level), success=pa.array(level == 3), front_door=front, rooms=listed, doors=answered,
        errors=pa.ListArray.from_arrays(offsets(row, n), _ints(wrong - start[row])),
    )


def _read_counted(lists: pa.Array) -> pa.Array:
    return _struct(n_tokens=lists.value_lengths().cast(pa.int32()), parsed=_read(lists))


def counted(tokens: Column) -> Column:
    """`parsed` and the number of tokens, as a struct, so that the list itself need not be kept for its length."""
    return F.arrow_udf(_read_counted, f"struct<n_tokens:int,parsed:{PARSED}>")(tokens)


def parsed(tokens: Column) -> Column:
    """The `PARSED` struct of a token list; null for a null list."""
    return F.arrow_udf(_read, PARSED)(tokens)
