"""The tolerant reading of answers over Arrow batches: all sequences of a batch are read together."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from planmill.constants import MAX_COORD
from planmill.functions.flat import offsets, ranges
from planmill.operators.strict import DOOR, Tokens, _ints, _struct

PLAN = (
    f"struct<rooms:array<struct<rid:int,type:string,coords:array<int>>>,edges:array<struct<pair:array<int>,door:array<{DOOR}>>>,"
    f"front_door:{DOOR},spatial:array<struct<rid_a:int,rid_b:int,direction:string>>>"
)
_SPATIAL = pa.struct([("rid_a", pa.int32()), ("rid_b", pa.int32()), ("direction", pa.string())])

_ANSWER = re.compile(rb"[^O\n]*O([^Ee\n]*)")
_BLOCKS = re.compile(rb"F[^d]*d?|R[^r]*r?|D[^d]*d?")


def _numbers(tokens, at, end):
    """Clamped numbers of the x / y letters of blocks: (values, number of the block of each)."""
    p, block = ranges(at, end - at)
    held = (tokens.letters[p] == ord("x")) | (tokens.letters[p] == ord("y"))
    return np.clip(tokens.values[p[held]], 0, MAX_COORD), block[held]


def _doors(tokens, at, end):
    """(has four numbers, x, y, w, h) of blocks."""
    values, block = _numbers(tokens, at, end)
    count = np.bincount(block, minlength=len(at))
    first = np.cumsum(count) - count
    whole = count >= 4
    return whole, [values[first[whole] + k] for k in range(4)]


def _plain(tokens):
    """Lines in which no block opens inside another: (which, by opening letter the table (line, place, end) of closed blocks)."""
    c, start = tokens.letters, tokens.start
    next_of = lambda places, at: np.append(places, len(c))[np.searchsorted(places, at)]
    o = next_of(np.flatnonzero(c == ord("O")), start)
    good = o < start + tokens.length
    begin = np.where(good, o, start) + 1
    stop = next_of(np.flatnonzero((c == ord("E")) | (c == ord("e")) | (c == ord("\n"))), begin)
    at = np.flatnonzero((c == ord("F")) | (c == ord("R")) | (c == ord("D")))
    line = np.searchsorted(start, at, "right") - 1
    held = (at >= begin[line]) & (at < stop[line])
    at, line = at[held], line[held]
    room = c[at] == ord("R")
    end = np.where(room, *(next_of(np.flatnonzero(c == ord(k)), at) for k in "rd")) + 1
    closed = end <= stop[line]
    end = np.where(closed, end, stop[line])
    inside = (line[1:] == line[:-1]) & (at[1:] < end[:-1])
    good[line[1:][inside]] = False
    closed &= good[line]
    return good, {k: np.stack([line, at, end])[:, closed & (c[at] == ord(k))] for k in "FRD"}


def _read(lists: pa.Array) -> pa.Array:
    tokens = Tokens(lists)
    text, n = tokens.text, len(lists)
    found = {"F": [], "R": [], "D": []}
    close = {"F": ord("d"), "R": ord("r"), "D": ord("d")}
    known, plain = _plain(tokens) if n else (np.zeros(0, bool), dict.fromkeys(found, np.zeros((3, 0), np.int64)))
    for k in np.flatnonzero(~known).tolist():
        answer = _ANSWER.match(text, int(tokens.start[k]))
        if not answer:
            continue
        for m in _BLOCKS.finditer(text, *answer.span(1)):
            a, z = m.span()
            kind = chr(text[a])
            if text[z - 1] == close[kind]:
                found[kind].append((k, a, z))

    def table(kind):
        both = np.concatenate([np.array(found[kind], np.int64).reshape(-1, 3).T, plain[kind]], axis=1)
        return both[:, np.argsort(both[1], kind="stable")]

    row, at, end = table("R")
    read = np.bincount(row, minlength=n) > 0
    p, room = ranges(at, end - at)
    typed = tokens.letters[p] == ord("t")
    word = np.full(len(at), -1)
    word[room[typed]] = tokens.words[p[typed]]  # the last one stays
    own, place = np.unique(word, return_inverse=True)
    names = pa.array(["unknown" if w < 0 else tokens.names[w][6:-1] for w in own], pa.string())
    values, of = _numbers(tokens, at, end)
    first = np.cumsum(np.bincount(row, minlength=n)) - np.bincount(row, minlength=n)
    rooms = pa.ListArray.from_arrays(offsets(row, n), _struct(
        rid=_ints(np.arange(len(row)) - first[row]),
        type=names.take(pa.array(place, pa.int32())),
        coords=pa.ListArray.from_arrays(offsets(of, len(at)), _ints(values)),
    ))

    row, at, end = table("D")
    whole, xywh = _doors(tokens, at, end)
    m = int(whole.sum())
    doors = _struct(**{f: _ints(v) for f, v in zip("xywh", xywh, strict=True)})
    edges = pa.ListArray.from_arrays(offsets(row[whole], n), _struct(
        pair=pa.ListArray.from_arrays(_ints(2 * np.arange(m + 1)), _ints(np.zeros(2 * m))),
        door=pa.ListArray.from_arrays(_ints(np.arange(m + 1)), doors),
    ))

    # The last closed front-door block of a sequence decides.
    row, at, end = table("F")
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    row, at, end = row[last], at[last], end[last]
    whole, xywh = _doors(tokens, at, end)
    p, block = ranges(at, end - at)
    none = np.bincount(block[tokens.letters[p] == ord("n")], minlength=len(at)) > 0
    of_row = np.full(n, -1)
    of_row[row[whole]] = np.where(none[whole], -1, np.arange(int(whole.sum())))
    front = _struct(**{f: _ints(v) for f, v in zip("xywh", xywh, strict=True)}).take(pa.array(of_row, pa.int32(), mask=of_row < 0))
    spatial = pa.ListArray.from_arrays(_ints(np.zeros(n + 1)), pa.array([], _SPATIAL))
    return _struct(pa.array(~read), rooms=rooms, edges=edges, front_door=front, spatial=spatial)


def plan_of(tokens: Column) -> Column:
    """The `PLAN` struct of an answer's token list; null where it has no <OUTPUT> or no closed room."""
    return F.arrow_udf(_read, PLAN)(tokens)
