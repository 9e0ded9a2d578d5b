"""Operator 6, benchmark decontamination: an FM-index per block of documents, windows searched in it.

A task reads its documents in blocks, the shards of the index. Words become numbers of the
benchmark's vocabulary; only runs of known words that can hold a window go into the index. All
windows are searched backwards at once, occurrences are located, and covered words are merged.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.llm.fm_index import FmIndex
from planmill.llm.segments import in_parts, text_groups

WINDOW = 10
GROUP_CHARS = 1 << 22
GROUP_BYTES = 8 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8").lower())


class Windows:
    """Different windows of a group of items, as rows of word numbers by length."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for at in range(max(1, len(own) - width + 1) if own else 0):
                found.setdefault(tuple(own[at : at + width]), set()).add("" if item is None else str(item))
        self.by_length: dict[int, tuple[np.ndarray, list]] = {}
        for n in sorted({len(w) for w in found}):
            same = [w for w in found if len(w) == n]
            self.by_length[n] = (np.array(same, np.int64), [sorted(found[w]) for w in same])
        self.shortest = min(self.by_length, default=0)

    def occurrences(self, docs: list[list[bytes]]):
        """Yields (document, first word, past-last word, items) for each occurrence of a window."""
        get = self.vocabulary.get
        numbers, starts, at = [], [], 0
        for doc in docs:
            starts.append(at)
            numbers.append(np.array([get(w, 0) for w in doc] + [0], np.int64))
            at += len(doc) + 1
        if not self.by_length or not numbers:
            return
        row = np.concatenate(numbers)
        known = np.concatenate([[0], (row > 0).astype(np.int8), [0]])
        begins, ends = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = ends - begins >= self.shortest
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return
        mark = np.zeros(len(row) + 1, np.int64)
        mark[begins] += 1
        mark[ends + 1] -= 1  # the word after a run, a separator, stays with it
        kept = np.flatnonzero(np.cumsum(mark)[:-1])
        index = FmIndex(np.maximum(row[kept], 1))
        starts = np.array(starts)
        for n, (patterns, items) in self.by_length.items():
            low, high = index.search(patterns)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            size = high[hit] - low[hit]
            rows = np.repeat(low[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            place = kept[index.locate(rows)]
            doc = np.searchsorted(starts, place, "right") - 1
            first = place - starts[doc]
            for d, f, p in zip(doc.tolist(), first.tolist(), np.repeat(hit, size).tolist(), strict=True):
                yield d, f, f + n, items[p]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the bytes from the first to the last word of each span of words."""
    data = text.encode("utf-8")
    places = [m.span() for m in _WORD.finditer(data.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8")


def item_groups(benchmark: DataFrame, group_bytes: int) -> list[list[tuple]]:
    """Items (item_id, text) in groups of about `group_bytes`, each small enough to send out."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(total) // group_bytes))
    group = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [[tuple(r) for r in items.filter(group == g).collect()] for g in range(count)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents without the words of benchmark windows; all columns of `docs` are kept.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A window is
    `width` consecutive words of an item, or all its words if it has fewer. Words inside any
    occurrence are hit; hit neighbours merge into spans, and `text` loses each span from its first
    to its last word. Adds n_words, n_hit, n_items, items (the ids, as sorted strings) and spans
    (word ranges, as [first, past-last, ...]); columns of `docs` with these names give way.

    A benchmark of more than `group_bytes` is searched in several passes over the documents, one
    group of items each. Null text stays null and has no words; an item without words has no
    window; a null item_id counts as an empty string. Repeated documents or items change nothing for
    others. An empty table of documents gives no rows; an empty benchmark hits nothing.
    """
    added = ["n_words", "n_hit", "n_items", "items", "spans"]
    docs = docs.drop(*added)
    columns = list(docs.columns)
    at = columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    n = len(columns)

    def search(windows: Windows, last: bool):
        def run(batches):
            for batch in in_parts(batches, 4096):
                begin = 0
                for group in text_groups(batch.column(at).to_pylist(), GROUP_CHARS):
                    part = batch.slice(begin, len(group))
                    begin += len(group)
                    doc_words = [words(t) for t in group]
                    old = part.columns[n:]
                    spans = [list(zip(s[::2], s[1::2], strict=True)) for s in old[1].to_pylist()] if old else [[] for _ in group]
                    items = [set(x) for x in old[0].to_pylist()] if old else [set() for _ in group]
                    for d, f, e, own in windows.occurrences(doc_words):
                        spans[d].append((f, e))
                        items[d].update(own)
                    merged = [_merged(s) for s in spans]
                    arrays = part.columns[:n]
                    if last:  # earlier passes still need the whole text
                        texts = part.column(at).to_pylist()
                        kept = [cut(t, s) if s else t for t, s in zip(texts, merged, strict=True)]
                        arrays[at] = pa.array(kept, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *arrays,
                            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                            pa.array([[v for s in x for v in s] for x in merged], pa.list_(pa.int32())),
                            pa.array([len(w) for w in doc_words], pa.int64()),
                        ],
                        [*columns, "items", "spans", "n_words"],
                    )

        return run

    schema = f"{fields}, items array<string>, spans array<int>, n_words bigint"
    out = docs
    groups = item_groups(benchmark, group_bytes)
    for k, group in enumerate(groups, 1):
        out = out.mapInArrow(search(Windows(group, width), k == len(groups)), schema)
    return out.select(
        *[F.col(f"`{c}`") for c in columns],
        "n_words",
        F.expr("aggregate(sequence(0, size(spans) div 2), 0L, (s, i) -> s + coalesce(get(spans, 2 * i + 1), 0) - coalesce(get(spans, 2 * i), 0))").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        "items",
        "spans",
    )
