"""Operator 1, token-ID output: shards of raw ids with a minimal perfect hash index over keys.

A store is a folder of Parquet rows, one per shard. Columns: part and shard (their order is that of
doc_id), min_id and max_id, n_tokens, rel_start (ids of the part before the shard), payload (raw
little-endian ids, 2 bytes wide where the vocabulary allows it, else 4), bounds (int64, where each
record starts, and the end), doc_ids (of each record) and the index: pilots (int32), and by slot
fingerprints (uint32), firsts (int32, first record of the key) and counts (int32, its records).
A key is found by one hash, one slot, one comparison; the payload is read at its bounds.
"""

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planmill.llm import perfect_hash
from planmill.llm.segments import SegmentCodes, segments, text_groups

SHARD_TOKENS = 1 << 18
GROUP_CHARS = 1 << 20
RUN_SEGMENTS = 2048

STORE_SCHEMA = (
    "part int, shard int, min_id bigint, max_id bigint, n_tokens bigint, rel_start bigint, width int,"
    " payload binary, bounds binary, doc_ids array<bigint>, pilots binary, fingerprints binary,"
    " firsts binary, counts binary"
)


@functools.lru_cache(maxsize=2)
def _codes(vocabulary: bytes, added_tokens: bool) -> tuple[SegmentCodes, int, re.Pattern | None]:
    """Segment ids by the tokenizers library, the bytes per stored id, and what finds added tokens."""
    tokenizer = Tokenizer.from_buffer(vocabulary)
    tokenizer.encode_special_tokens = not added_tokens
    if tokenizer.normalizer is not None or '"ByteLevel"' not in vocabulary.decode("utf-8"):
        raise ValueError("a byte-level vocabulary without normalizer is needed")
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    added = tokenizer.get_added_tokens_decoder() if added_tokens else {}
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("added tokens that depend on the text around them are not supported")
    size = max([*vocab.values(), *added]) + 2
    n_bytes = np.zeros(size, np.int64)
    for token, i in vocab.items():
        n_bytes[i] = len(token)  # one character per byte
    for i, token in added.items():
        n_bytes[i] = len(token.content.encode("utf-8"))
    names = sorted((t.content for t in added.values()), key=len, reverse=True)
    find = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def encode_many(new: list[str]):
        ids, lens = [], []
        # Only the first segment of a text has no space in front; such a one opens a run of its own.
        cuts = sorted({*range(0, len(new), RUN_SEGMENTS), *(i for i, s in enumerate(new) if s[0] != " ")})
        for begin, end in zip(cuts, [*cuts[1:], len(new)], strict=True):
            run = new[begin:end]
            text = "".join(run)
            # One text a call: the ids are those of `encode`, without the offsets that nothing here reads.
            got = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            sizes = map(len, run) if text.isascii() else map(len, map(str.encode, run))
            at = np.searchsorted(np.cumsum(n_bytes[got]), np.cumsum(np.fromiter(sizes, np.int64, len(run)))) + 1
            ids.append(got)
            lens.append(np.diff(at, prepend=0))
        return np.concatenate(ids), np.concatenate(lens)

    return SegmentCodes(encode_many), (2 if size <= 1 << 16 else 4), find


def _parts(text: str, find: re.Pattern | None) -> list[str]:
    """Segments of a text; an added token is one of its own, as the text before it ends there."""
    if find is None or not find.search(text):
        return segments(text)
    return [s for k, t in enumerate(find.split(text)) for s in ([t] if k % 2 else segments(t))]


def _with_end(ids: np.ndarray, lens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each document."""
    out = np.full(len(ids) + len(lens), end_id, np.uint32)
    ends = np.cumsum(lens + 1) - 1
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = ids
    return out, lens + 1


def _index(doc_ids: list) -> dict:
    """Index columns over the keys of a shard whose records are in key order; null is no key."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    keys, firsts, counts = np.unique(known, return_index=True, return_counts=True)
    firsts = firsts + (len(doc_ids) - len(known))  # nulls come first
    words = keys.view(np.uint64)
    pilots = perfect_hash.build(words)
    slot = perfect_hash.slots(words, pilots, len(keys))
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slot] = np.arange(len(keys))
    return {
        "pilots": pilots.astype("<i4").tobytes(),
        "fingerprints": perfect_hash.fingerprints(words)[by_slot].astype("<u4").tobytes(),
        "firsts": firsts[by_slot].astype("<i4").tobytes(),
        "counts": counts[by_slot].astype("<i4").tobytes(),
    }


def _find(shard: dict, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first record or -1, number of records) of each wanted key."""
    marks = np.frombuffer(shard["fingerprints"], "<u4")
    if not len(marks):
        return np.full(len(wanted), -1), np.zeros(len(wanted), np.int64)
    words = wanted.view(np.uint64)
    slot = perfect_hash.slots(words, np.frombuffer(shard["pilots"], "<i4").astype(np.int64), len(marks))
    known = marks[slot] == perfect_hash.fingerprints(words)
    firsts = np.frombuffer(shard["firsts"], "<i4")[slot]
    counts = np.frombuffer(shard["counts"], "<i4")[slot]
    return np.where(known, firsts, -1), np.where(known, counts, 0)


def encode_shards(
    docs: DataFrame, vocabulary: bytes, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, added_tokens: bool = False
) -> DataFrame:
    """Shard rows of all documents in ascending doc_id order (null first, ties by text hash).

    Null and empty texts hold the end id alone. Rows that share a doc_id are records of one key.
    An empty table gives no shards. Only doc_id and text are read. Rows are dealt out by range, with
    the row number as last tie-break, so that no repeated key can fill one task. With `added_tokens`,
    ids are those of the library's encode by default: an added token of the vocabulary (such as
    <|endoftext|>) is one id wherever a text holds it; without, it is text like any other.
    """
    order = ["doc_id", "_content", "_row"]
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        "text",
        F.xxhash64("text").alias("_content"),
        F.monotonically_increasing_id().alias("_row"),
    )
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("min_id", pa.int64()), ("max_id", pa.int64()),
         ("n_tokens", pa.int64()), ("rel_start", pa.int64()), ("width", pa.int32()), ("payload", pa.binary()),
         ("bounds", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("pilots", pa.binary()),
         ("fingerprints", pa.binary()), ("firsts", pa.binary()), ("counts", pa.binary())]
    )

    def write(batches):
        part = TaskContext.get().partitionId()
        codes, width, find = _codes(vocabulary, added_tokens)
        ids, lens, keys = [], [], []
        state = {"shard": 0, "start": 0}

        def shard():
            flat, each = np.concatenate(ids), np.concatenate(lens)
            known = [k for k in keys if k is not None]
            row = {
                "part": part, "shard": state["shard"], "min_id": min(known, default=None),
                "max_id": max(known, default=None), "n_tokens": len(flat), "rel_start": state["start"],
                "width": width, "payload": flat.astype(f"<u{width}").tobytes(),
                "bounds": np.concatenate([[0], np.cumsum(each)]).astype("<i8").tobytes(), "doc_ids": keys,
            }
            row.update(_index(keys))
            state["shard"] += 1
            state["start"] += len(flat)
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for group in text_groups(batch.column(1).to_pylist(), GROUP_CHARS):
                parts = [_parts(t, find) for t in group]
                flat, each = _with_end(*codes.encode_any(parts), end_id)
                ends, begin = np.cumsum(each), 0
                while begin < len(each):
                    room = shard_tokens - sum(map(len, ids)) + (ends[begin - 1] if begin else 0)
                    stop = max(begin + 1, int(np.searchsorted(ends, room, "right")))
                    ids.append(flat[(ends[begin - 1] if begin else 0) : ends[stop - 1]])
                    lens.append(each[begin:stop])
                    keys.extend(doc_ids[at + begin : at + stop])
                    begin = stop
                    if sum(map(len, ids)) >= shard_tokens:
                        yield shard()
                        ids, lens, keys = [], [], []
                at += len(group)
        if keys:
            yield shard()

    return dealt.mapInArrow(write, STORE_SCHEMA)


def write_store(docs: DataFrame, path: str, vocabulary: bytes, end_id: int = 0, added_tokens: bool = False) -> None:
    """Write the store of all documents into the folder `path`."""
    encode_shards(docs, vocabulary, end_id, added_tokens=added_tokens).write.option("parquet.block.size", 16 << 20).parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record of a store, read through its index.

    start counts the ids of all earlier records: within the part from the shard, and the sums of
    earlier parts (one row per written part) on top.
    """
    store = spark.read.schema(STORE_SCHEMA).parquet(path)

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                bounds = np.frombuffer(s["bounds"], "<i8")
                flat = np.frombuffer(s["payload"], f"<u{s['width']}").astype("<u4")
                doc_ids = s["doc_ids"]
                nulls = sum(k is None for k in doc_ids)
                keys = np.array(doc_ids[nulls:], np.int64)
                first, _ = _find(s, keys)
                turn = np.arange(len(keys)) - np.searchsorted(keys, keys)
                record = np.concatenate([np.arange(nulls), first + turn]).astype(np.int64)
                begin, end = bounds[record], bounds[record + 1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "part": pa.array([s["part"]] * len(doc_ids), pa.int32()),
                        "start": pa.array(s["rel_start"] + begin, pa.int64()),
                        "n_tokens": pa.array(end - begin, pa.int64()),
                        "ids_crc32": pa.array(
                            [zlib.crc32(flat[b:e].tobytes()) for b, e in zip(begin, end, strict=True)], pa.int64()
                        ),
                    }
                )

    records = store.mapInArrow(read, "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        store.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return records.join(parts, "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the named documents: shards pruned by their key range, then the index."""
    if not 0 < len(doc_ids) <= 10_000:
        raise ValueError("name 1 to 10,000 documents")
    keys = np.unique(np.array(doc_ids, np.int64))
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    near = store.filter((F.col("max_id") >= int(keys[0])) & (F.col("min_id") <= int(keys[-1])))

    def read(batches):
        for batch in batches:
            for s in batch.to_pylist():
                inside = keys[(keys >= s["min_id"]) & (keys <= s["max_id"])]
                first, count = _find(s, inside)
                bounds = np.frombuffer(s["bounds"], "<i8")
                flat = np.frombuffer(s["payload"], f"<u{s['width']}")
                for k, f, c in zip(inside.tolist(), first.tolist(), count.tolist(), strict=True):
                    if f >= 0 and s["doc_ids"][f] == k:  # the fingerprint may agree by chance
                        rows = [flat[bounds[r] : bounds[r + 1]].astype(np.int64) for r in range(f, f + c)]
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array([k] * c, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int64()))}
                        )

    return near.mapInArrow(read, "doc_id bigint, ids array<bigint>")
