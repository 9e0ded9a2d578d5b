"""Operator 11, SentencePiece: merges taken from an agenda of adjacent pairs ordered by score.

A text is escaped as the vocabulary asks (a mark in front, blanks as marks) and cut before each run
of marks that follows another character. No piece of such a vocabulary holds a mark behind another
character, so no merge crosses a cut and each segment is merged on its own, once for all its
occurrences in the work of a task. Every text is checked against the library, batch by batch.
"""

import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planmill.llm.segments import SegmentCodes, gather, in_parts, text_groups

MARK = "▁"
GROUP_CHARS = 1 << 20
STRETCH_CHARS = 1 << 20
KNOWN_SEGMENTS = 800_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_CUT = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")
_PLACE = 40
#: Segments up to this length share one agenda in arrays; a longer one has a heap of its own.
SHORT = 64
_NONE = np.int64(1) << 40


class PieceModel:
    """Pieces, the order of their scores and the library's processor of a merge-type vocabulary."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._expect_plain_normaliser()
        size = self.library.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.of_byte: dict[int, int] = {}
        shown = [b""] * size
        kind = np.zeros(size, np.int8)
        scores = {}
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.of_byte[value] = i
                shown[i], kind[i] = bytes([value]), 1
            elif self.library.is_unknown(i):
                shown[i] = self.library.decode([i]).encode("utf-8")
            elif self.library.is_control(i):
                kind[i] = 2
            elif self.library.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            else:
                self.pieces[piece] = i
                scores[piece] = self.library.get_score(i)
                shown[i] = piece.replace(MARK, " ").encode("utf-8")
                kind[i] = 3 if piece.startswith(MARK) else 0
        order = {s: at for at, s in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Place of a piece in the order of scores, best first; pieces of one score share a place.
        self.place = {p: order[s] for p, s in scores.items()}
        self._index_pairs(size)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.kind = kind
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_lens = np.array([len(s) for s in shown], np.int64)
        self.shown_starts = np.cumsum(self.shown_lens) - self.shown_lens

    def _expect_plain_normaliser(self):
        probe = " a  　ÅÅﬁ \n"
        if self.library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only vocabularies that keep characters and blanks and put a mark in front")

    def _index_pairs(self, size):
        """Sorted pairs of pieces with the piece that each makes."""
        if not self.of_byte or not all(c in self.pieces for p in self.pieces for c in p):
            raise ValueError("only vocabularies with byte pieces and a piece for each of their characters")
        symbols = self.pieces
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.n_symbols = size
        pairs = {}
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = (self.place[piece], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.places, self.made = np.array(list(pairs.values()), np.int64)[order].T

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair of symbols in the sorted pairs; -1 where the two make no piece."""
        key = np.where((left >= self.n_symbols) | (right >= self.n_symbols), -1, left * self.n_symbols + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def merge_short(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many segments by one agenda: every round merges the best pair of each segment.

        Result: (segment, symbol) of what is left; symbols from `n_symbols` on are characters without a piece.
        """
        sizes = np.array([len(s) for s in segments], np.int64)
        chars = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.of_char[chars].astype(np.int64)
        symbol = np.where(symbol < 0, self.n_symbols + chars, symbol)
        owner = np.repeat(np.arange(len(segments)), sizes)

        def agenda(left):
            """(place of the pair, its number) of the pairs that begin at `left`."""
            right = np.minimum(left + 1, len(symbol) - 1)
            number = self._pairs(symbol[left], symbol[right])
            number[(owner[left] != owner[right]) | (left == right)] = -1
            return np.where(number < 0, _NONE, self.places[number]), number

        place, number = agenda(np.arange(len(symbol)))
        done = []
        while len(symbol):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(place, heads)
            over = best == _NONE
            lens = np.diff(np.append(heads, len(symbol)))
            if over.any():
                rest = np.repeat(~over, lens)
                done.append((owner[~rest], symbol[~rest]))
                symbol, owner, place, number = (x[rest] for x in (symbol, owner, place, number))
                best, lens = best[~over], lens[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(place == np.repeat(best, lens))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]
            symbol[at] = self.made[number[at]]
            kept = np.ones(len(symbol), bool)
            kept[at + 1] = False
            at -= np.arange(len(at))
            symbol, owner, place, number = (x[kept] for x in (symbol, owner, place, number))
            touched = np.concatenate([at, at[at > 0] - 1])
            place[touched], number[touched] = agenda(touched)
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment: the best pair on the agenda is merged, the leftmost of equals, to the end."""
        symbols = list(segment)
        n = len(symbols)
        place = self.place
        pair = [place.get(symbols[i] + symbols[i + 1], -1) for i in range(n - 1)] + [-1]
        agenda = [p << _PLACE | i for i, p in enumerate(pair) if p >= 0]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                entry = heapq.heappop(agenda)
                left = entry & ((1 << _PLACE) - 1)
                if pair[left] != entry >> _PLACE:
                    continue
                right = after[left]
                symbols[left] += symbols[right]
                symbols[right] = None
                pair[right] = -1
                follow = after[left] = after[right]
                if follow < n:
                    before[follow] = left
                    p = pair[left] = place.get(symbols[left] + symbols[follow], -1)
                    if p >= 0:
                        heapq.heappush(agenda, p << _PLACE | left)
                else:
                    pair[left] = -1
                ahead = before[left]
                if ahead >= 0:
                    p = pair[ahead] = place.get(symbols[ahead] + symbols[left], -1)
                    if p >= 0:
                        heapq.heappush(agenda, p << _PLACE | ahead)
        return self._ids(s for s in symbols if s is not None)

    def _ids(self, symbols) -> list[int]:
        out = []
        for s in symbols:
            piece = self.pieces.get(s)
            if piece is not None:
                out.append(piece)
            else:
                out.extend(self.of_byte[b] for b in s.encode("utf-8"))
        return out

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each segment)."""
        sizes = np.array([len(s) for s in segments], np.int64)
        short, long_ = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
        flat = symbol = np.zeros(0, np.int64)
        lens = np.zeros(len(segments), np.int64)
        if len(short):
            owner, symbol = self.merge_short([segments[i] for i in short.tolist()])
            order = np.argsort(owner, kind="stable")
            flat, per_symbol = self._ids_of_symbols(symbol[order])
            lens[short] = np.bincount(owner[order], weights=per_symbol, minlength=len(short)).astype(np.int64)
        if not len(long_):
            return flat.astype(np.uint32), lens
        own = [self.merge(segments[i]) for i in long_.tolist()]
        lens[long_] = [len(x) for x in own]
        flat = np.concatenate([flat, *(np.array(x, np.int64) for x in own)])
        at = np.concatenate([short, long_])
        starts = np.zeros(len(segments), np.int64)
        starts[at] = np.cumsum(lens[at]) - lens[at]
        return gather(flat, starts, lens).astype(np.uint32), lens

    def _ids_of_symbols(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each symbol); a character without a piece gives its byte ids."""
        lens = np.ones(len(symbol), np.int64)
        odd = symbol >= self.n_symbols
        if not odd.any():
            return symbol, lens
        values, which = np.unique(symbol[odd], return_inverse=True)
        own = [self._ids([chr(int(v) - self.n_symbols)]) for v in values]
        sizes = np.array([len(x) for x in own], np.int64)
        table = np.concatenate([np.arange(self.n_symbols), *(np.array(x, np.int64) for x in own)])
        starts = symbol.copy()
        starts[odd] = (self.n_symbols + np.cumsum(sizes) - sizes)[which]
        lens[odd] = sizes[which]
        return gather(table, starts, lens), lens

    def stretches(self, text: str) -> list[str]:
        """A long text in stretches of bounded length; each begins where a segment begins."""
        if len(text) <= STRETCH_CHARS or not self.cuts:
            return [text]
        out, begin = [], 0
        while len(text) - begin > STRETCH_CHARS:
            found = _CUT.search(text, begin + STRETCH_CHARS)
            if found is None:
                break
            out.append(text[begin : found.start()])
            begin = found.start()
        return [*out, text[begin:]]

    def segments(self, stretch: str, first: bool) -> list[str]:
        """Segments of a stretch; the first one of a text gets the mark in front."""
        escaped = stretch.replace(" ", MARK)
        if first:
            escaped = MARK + escaped if escaped else escaped
        if self.cuts:
            return _SEGMENT.findall(escaped)
        return [escaped] if escaped else []

    def check(self, stretches: list[str], first: list[bool], ids: list[np.ndarray]) -> None:
        """Raise where the library gives other ids.

        Stretches after the first begin with a mark of their own; the library sets that one itself.
        """
        plain = [s if f else s[1:] for s, f in zip(stretches, first, strict=True)]
        expected = self.library.encode(plain, num_threads=1)
        for own, theirs, shown, begins in zip(ids, expected, plain, first, strict=True):
            if not begins and not shown:
                theirs = self.merge(MARK)
            if own.tolist() != theirs:
                raise AssertionError(f"ids differ from the library's: {shown[:80]!r}")

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for: byte ids as UTF-8, one mark less in front, control ids silent.

        Bytes that are no UTF-8 give one replacement character each.
        """
        if not len(ids):
            return ""
        kind = self.kind[ids]
        lens = self.shown_lens[ids]
        starts = self.shown_starts[ids]
        heard = np.flatnonzero(lens)
        if len(heard) and kind[heard[0]] == 3:
            lens, starts = lens.copy(), starts.copy()
            lens[heard[0]] -= 1
            starts[heard[0]] += 1
        flat = gather(self.shown, starts, lens).tobytes()
        if not ((kind == 2).any() and (kind == 1).any()):
            try:
                return flat.decode("utf-8")
            except UnicodeDecodeError:
                pass
        return self._decode_broken(kind, starts, lens)

    def _decode_broken(self, kind, starts, lens) -> str:
        out, held = [], bytearray()

        def release():
            at = 0
            while at < len(held):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + width].decode("utf-8"))
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for k, s, n in zip(kind.tolist(), starts.tolist(), lens.tolist(), strict=True):
            own = self.shown[s : s + n].tobytes()
            if k == 1:
                held.extend(own)
            else:
                release()
                out.append(own.decode("utf-8"))
        release()
        return "".join(out)


@functools.lru_cache(maxsize=2)
def _codes(model: bytes) -> tuple[SegmentCodes, PieceModel]:
    pieces = PieceModel(model)
    return SegmentCodes(pieces.merge_all, KNOWN_SEGMENTS), pieces


def _encode_group(texts: list[str], codes: SegmentCodes, model: PieceModel, check: bool):
    """(all ids, number of ids of each text) of a few texts."""
    stretches, first = [], []
    for t in texts:
        own = model.stretches(t)
        stretches.extend(own)
        first.extend([True] + [False] * (len(own) - 1))
    flats, lens = [], []
    for begin in range(0, len(stretches), 256):
        part, heads = stretches[begin : begin + 256], first[begin : begin + 256]
        segments = [model.segments(s, f) for s, f in zip(part, heads, strict=True)]
        flat, own_lens = codes.encode_any(segments)
        if check:
            model.check(part, heads, np.split(flat, np.cumsum(own_lens)[:-1]))
        flats.append(flat)
        lens.append(own_lens)
    per_stretch = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
    heads = np.append(np.flatnonzero(first), len(first))
    return np.concatenate(flats), np.diff(per_stretch[heads])


def _encoded(docs: DataFrame, model: bytes, check: bool, with_decoded: bool) -> DataFrame:
    def rows(batches):
        codes, pieces = _codes(model)
        for batch in in_parts(batches, 1024):
            begin = 0
            for group in text_groups(batch.column(1).to_pylist(), GROUP_CHARS):
                flat, lens = _encode_group(group, codes, pieces, check)
                ends = np.cumsum(lens)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                columns = [batch.column(0).slice(begin, len(group)), ids]
                if with_decoded:
                    decoded = [pieces.decode(own.astype(np.int64)) for own in np.split(flat, ends[:-1])]
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
                begin += len(group)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, ids array<int>" + ", decoded string" * with_decoded
    return docs.select("doc_id", "text").mapInArrow(rows, fields)


def encode(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without begin and end ids.

    `model` is the content of a SentencePiece file of the merge type whose normaliser keeps characters
    and blanks, with a piece for each byte; others are an error. Characters without a piece become byte ids. With `check`, the library encodes every text too and a difference is an error.
    Null and empty texts have no ids. Texts of any length are encoded whole, in stretches. Rows that
    share a doc_id are encoded each; a null doc_id stays null; an empty table gives no rows. Only
    doc_id and text are read.
    """
    return _encoded(docs, model, check, False)


def round_trip(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """(doc_id, ids, decoded): as `encode`, with the text that the ids stand for, in one pass."""
    return _encoded(docs, model, check, True)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Adds `decoded`, the text that `ids` stand for; null ids give null. All columns stay."""
    columns = encoded.columns
    at = columns.index("ids")
    if "decoded" in columns:
        raise ValueError("there is a column `decoded` already")

    def rows(batches):
        _, pieces = _codes(model)
        for batch in in_parts(batches, 256):
            out = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*columns, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(rows, f"{fields}, decoded string")
