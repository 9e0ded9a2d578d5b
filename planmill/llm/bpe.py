"""Operator 7, byte-level BPE: merges replayed over the distinct pieces of a block of texts."""

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from planmill.llm.segments import SegmentCodes, gather, in_parts, segments, text_groups

GROUP_CHARS = 1 << 20
KNOWN_SEGMENTS = 200_000


class Merges:
    """Ranks of a byte-level vocabulary, and the merges that make each token."""

    def __init__(self, rank_file: bytes):
        self.ranks = {
            base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)
        }
        self.size = max(self.ranks.values()) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.results = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lens = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lens) - self.token_lens

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges into; -1 where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.results[at], -1)

    def one_by_one(self, piece: bytes) -> list[int]:
        """Ids of a piece by single merges: the leftmost pair of lowest rank, again and again."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1]), i) for i in range(len(parts) - 1)]
            found = [x for x in found if x[0] is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_starts[ids], self.token_lens[ids]).tobytes()


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, number of ids of each): every merge once, in rank order.

    All pieces lie in one linked row of symbols. An inverted index has, for each rank, the places
    whose pair merges into it. Ranks come up in order; the places of a rank that still hold the pair
    are merged together, and only the pairs that touch them are looked up and indexed anew. Within
    a run such as "aaa" the leftmost pair wins. Where a merge brings up a pair of lower rank than
    its own, the piece is done again by single merges. A piece that is a token is that token.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), sizes
    symbol = np.append(merges.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], -1)
    ends = np.cumsum(sizes)
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    last, first = ends[sizes > 0] - 1, (ends - sizes)[sizes > 0]
    after[last] = n
    before[first] = n
    alive = np.ones(n, bool)
    rank = np.full(n + 1, -1, np.int64)
    rank[:n] = np.where(after[:n] < n, merges.rank_of(symbol[:n], symbol[np.minimum(after[:n], n)]), -1)

    found = np.flatnonzero(rank >= 0)
    found = found[np.argsort(rank[found], kind="stable")]
    values, begins = np.unique(rank[found], return_index=True)
    places: dict[int, list] = {int(r): [p] for r, p in zip(values, np.split(found, begins[1:]), strict=True)} if len(found) else {}
    queue = sorted(places)
    odd = []
    while queue:
        r = heapq.heappop(queue)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        right = after[at]
        if len(at) > 1 and (right[:-1] == at[1:]).any():
            keep, gone = [], -1
            for p, q in zip(at.tolist(), right.tolist(), strict=True):
                if p != gone:
                    keep.append(p)
                    gone = q
            at = np.array(keep)
            right = after[at]
        follow = after[right]
        symbol[at] = r
        alive[right] = False
        rank[right] = -1
        after[at] = follow
        before[follow] = at
        left = before[at]
        touched = np.concatenate([at, left[left < n]])
        touched = touched[alive[touched]]
        nxt = after[touched]
        new = np.where(nxt < n, merges.rank_of(symbol[touched], symbol[nxt]), -1)
        rank[touched] = new
        has = new >= 0
        if not has.any():
            continue
        touched, new = touched[has], new[has]
        low = new <= r
        if low.any():
            odd.extend(touched[low].tolist())
        order = np.argsort(new, kind="stable")
        touched, new = touched[order], new[order]
        cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
        for value, own in zip(new[np.concatenate([[0], cuts])].tolist(), np.split(touched, cuts), strict=True):
            own.sort()
            if value in places:
                places[value].append(own)
            else:
                places[value] = [own]
                heapq.heappush(queue, value)

    counts = np.zeros(len(pieces), np.int64)
    full = np.flatnonzero(sizes)
    counts[full] = np.add.reduceat(alive.astype(np.int64), (ends - sizes)[full])
    ids = symbol[:n][alive]
    whole = {i: [t] for i, p in enumerate(pieces) if (t := merges.ranks.get(p)) is not None and counts[i] != 1}
    whole.update(
        {i: merges.one_by_one(pieces[i]) for i in set(np.searchsorted(ends, odd, "right").tolist()) if i not in whole}
        if odd else {}
    )
    if whole:
        rows = np.split(ids, np.cumsum(counts)[:-1])
        for i, own in whole.items():
            rows[i], counts[i] = np.array(own, np.int64), len(own)
        ids = np.concatenate(rows)
    return ids, counts


def encode_pieces(texts: list[str], pattern, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text) of texts that are split by the pattern on their own."""
    index: dict[str, int] = {}
    rows, per_text = [], []
    for t in texts:
        own = pattern.findall(t)
        rows.extend([index.setdefault(p, len(index)) for p in own])
        per_text.append(len(own))
    flat, lens = replay([p.encode("utf-8") for p in index], merges)
    rows = np.array(rows, np.int64)
    starts = np.cumsum(lens) - lens
    ids = gather(flat, starts[rows], lens[rows])
    total = np.concatenate([[0], np.cumsum(lens[rows])])
    return ids, np.diff(total[np.concatenate([[0], np.cumsum(per_text)])])


@functools.lru_cache(maxsize=2)
def _codes(rank_file: bytes, pattern: str) -> tuple[SegmentCodes, Merges]:
    merges, compiled = Merges(rank_file), regex.compile(pattern)
    return SegmentCodes(lambda new: encode_pieces(new, compiled, merges), KNOWN_SEGMENTS), merges


def _encoded(docs: DataFrame, rank_file: bytes, pattern: str, with_decoded: bool) -> DataFrame:
    def run(batches):
        codes, _ = _codes(rank_file, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            groups = text_groups(texts, GROUP_CHARS)
            wanted, limit = set(), codes.limit // 4
            begin = 0
            for stop, group in enumerate(groups, 1):
                for t in group:
                    wanted.update(segments(t))
                if len(wanted) < limit and stop < len(groups):
                    continue
                codes.learn(wanted)
                wanted = set()
                for own in groups[begin:stop]:
                    flat, lens = codes.encode([segments(t) for t in own])
                    cuts = np.concatenate([[0], np.cumsum(lens)]) * 4
                    data = flat.astype("<u4").tobytes()
                    yield [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                begin = stop

    def rows(batches):
        _, merges = _codes(rank_file, pattern)
        for batch in in_parts(batches, 4096):
            at = 0
            for ids in run([batch]):
                columns = [batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())]
                if with_decoded:
                    decoded = [merges.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids]
                    columns.append(pa.array(decoded, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
                at += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, ids binary" + ", decoded binary" * with_decoded
    return docs.select("doc_id", "text").mapInArrow(rows, fields)


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers.

    Merges are replayed over all new pieces of a few thousand texts at once. Null and empty texts have no
    ids. Rows that share a doc_id are encoded each; a null doc_id stays null; an empty table gives
    no rows. Only doc_id and text are read.
    """

    return _encoded(docs, rank_file, pattern, False)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): as `encode`, with the bytes that the ids stand for, in one pass."""
    return _encoded(docs, rank_file, pattern, True)


def decode(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for; null ids give null. All columns stay."""
    columns = encoded.columns
    at = columns.index("ids")

    def rows(batches):
        _, merges = _codes(rank_file, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = [
                    None if x is None else merges.decode(np.frombuffer(x, "<u4").astype(np.int64))
                    for x in part.column(at).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(out, pa.binary())], [*columns, "decoded"]
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(rows, f"{fields}, decoded binary")
