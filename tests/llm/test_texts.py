"""Operators over whole texts against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from planmill.llm import bpe, decontaminate, language, line_dedup, near_dedup, perfect_hash, segments, sharding
from planmill.llm import queries, suffix_dedup, token_store
from planmill.llm.rows import read_small_file

rng = random.Random(5)
VOCAB = ["w%d" % i for i in range(60)]


def sentence(n, source=rng):
    return " ".join(source.choice(VOCAB) for _ in range(n))


BASE = sentence(120)
ODD = [
    (None, "only a null id here and some more words"), (None, None), (7, None), (8, ""), (9, "   \n\n  "), (10, "é"),
    (11, "A\nB\nC\nD\nA\nB\nC\nE"), (12, "A\nB\nC"), (12, "A\nB\nC"), (13, "x\n\n\n\n\n\ny"), (14, "one two three"),
    (15, "ONE two\tthree"), (16, "long " * 20000), (17, BASE), (18, BASE), (19, BASE), (17, BASE), (20, "aaaa" * 100),
    (21, "b" + "aaaa" * 40), (22, "<|endoftext|> it's  12 ３４ \x00   x\x1c y"),
]
NEAR = []
for k in range(40):
    own = BASE.split()
    for _ in range(k % 7):
        own[rng.randrange(len(own))] = "edit%d" % rng.randrange(5)
    NEAR.append((100 + k, " ".join(own)))
TEXTS = ODD + NEAR + [(200 + k, sentence(5 + 7 * k) + "\n" + BASE[k * 9 : k * 9 + 90]) for k in range(30)]


def by_row(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# -- token store and byte-level BPE


def test_token_store(spark, make_docs, tmp_path):
    raw = read_small_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = str(tmp_path / "store")
    token_store.write_store(make_docs(TEXTS).repartition(3), path, raw)
    got = token_store.read_records(spark, path).collect()
    tk = Tokenizer.from_buffer(raw)
    tk.encode_special_tokens = True
    ids = {t: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for _, t in TEXTS}
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == Counter((i, len(ids[t]), crc(t)) for i, t in TEXTS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    found = token_store.lookup(spark, path, [17, 10, 5]).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((i, tuple(ids[t])) for i, t in TEXTS if i in (10, 17))


def test_token_store_query_has_added_tokens(spark, make_docs, tmp_path):
    """The query gives the ids of an unchanged Tokenizer, also around added tokens."""
    end = "<|endoftext|>"
    odd = [end, end * 2, f"a{end}b", f"a  {end}  b", f" {end} c  ", f"x\n {end}\n\ny", f"   {end}", "<|endof text|>", f"<{end}>", f"it{end}'s"]
    rows = TEXTS + [(500 + k, t) for k, t in enumerate(odd)]
    make_docs(rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    tk = Tokenizer.from_buffer(read_small_file(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {t: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    assert tk.token_to_id(end) in ids[odd[3]]
    got = queries.op1_token_store(spark, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == Counter((i, len(ids[t]), crc(t)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_store_shards_and_empty(spark, make_docs, tmp_path):
    raw = read_small_file(public_tokenizers.path("byte_bpe_50k.json"))
    shards = token_store.encode_shards(make_docs(TEXTS).coalesce(1), raw, shard_tokens=50).collect()
    assert len(shards) > 20 and sum(len(s.doc_ids) for s in shards) == len(TEXTS)
    path = str(tmp_path / "none")
    token_store.write_store(make_docs([]), path, raw)
    assert token_store.read_records(spark, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=300))
def test_perfect_hash(keys):
    words = np.array(sorted(keys), np.int64).view(np.uint64)
    pilots = perfect_hash.build(words)
    assert sorted(perfect_hash.slots(words, pilots, len(words)).tolist()) == list(range(len(words)))


@pytest.fixture(scope="module")
def ranks():
    return read_small_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_bpe_round_trip(make_docs, ranks, reference):
    encoded = bpe.encode(make_docs(TEXTS), ranks, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, ranks, public_tokenizers.PATTERN).collect()
    want = Counter((i, np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    at_once = bpe.round_trip(make_docs(TEXTS), ranks, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in at_once) == want
    assert bpe.encode(make_docs([]), ranks, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list(" \n\t\x00 \x1c\x85'abcstABé漢1２,.!|<")), max_size=60))
def test_segments_and_replay(ranks, reference, text):
    parts = segments.segments(text)
    assert "".join(parts) == text
    codes, _ = bpe._codes(ranks, public_tokenizers.PATTERN)
    codes.learn(set(parts))
    assert codes.encode([parts])[0].tolist() == reference.encode_ordinary(text)


def test_replay_odd_orders():
    """Ranks out of the order in which tokens can be built: pieces are done again by single merges."""
    tokens = [bytes([b]) for b in range(256)] + [b"abcd", b"cd", b"ab", b"abc", b"bc"]
    merges = bpe.Merges(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(300)]
    ids, lens = bpe.replay(words, merges)
    rows = np.split(ids, np.cumsum(lens)[:-1])
    for w, r in zip(words, rows, strict=True):
        assert r.tolist() == ([merges.ranks[w]] if w in merges.ranks else merges.one_by_one(w))


# -- suffix-array dedup


def brute_repeats(rows):
    first, out = {}, []
    key = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, float("inf")), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("block_bytes,hot_blocks", [(1 << 22, 64), (2000, 64), (2000, 2)])
def test_suffix_dedup(make_docs, block_bytes, hot_blocks):
    rows = TEXTS + [(300, "x" * 49), (301, "x" * 49), (302, "yy" + "x" * 50), (303, "zx" + "x" * 60)]
    out = suffix_dedup.remove_repeats(make_docs(rows).repartition(2), block_bytes=block_bytes, hot_blocks=hot_blocks).collect()
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)
    for r in out:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)) == r.n_removed


@pytest.mark.parametrize("turned", [False, True])
def test_suffix_dedup_equal_strings_in_one_block(make_docs, monkeypatch, turned):
    """Answers to contexts of one string and to that string, in both orders of arrival."""
    remove = suffix_dedup._remove

    def in_order(*args):
        run = remove(*args)
        return lambda key, table: run(key, table.take(list(range(len(table)))[:: -1 if turned else 1]))

    monkeypatch.setattr(suffix_dedup, "_remove", in_order)
    passages = [sentence(40, random.Random(k))[:50] for k in range(8)]
    rows = [(k, "before it " + p + " and after") for k, p in enumerate(passages)]
    rows += [(100 + 10 * k + j, p) for k, p in enumerate(passages) for j in range(3)]
    rows += [(15 + 200 * (k % 2), "<" + p + ">") for k, p in enumerate(passages)]
    out = suffix_dedup.remove_repeats(make_docs(rows).coalesce(1), hot_blocks=0).collect()
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows)


def test_suffix_dedup_empty(make_docs):
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


# -- line dedup


def test_line_dedup(make_docs):
    got = {}
    for r in line_dedup.dedup_lines(make_docs(TEXTS)).collect():
        got.setdefault(r.doc_id, r)
    assert got[11].text == "A\nB\nC\nD\nE" and (got[11].n_lines, got[11].n_removed, got[11].n_spans) == (8, 3, 1)
    assert got[12].text == "" and got[12].n_removed == 3
    assert got[13].text == "x\n\n\n\n\n\ny" and got[13].n_removed == 0
    assert got[7].text is None and got[7].n_lines == 0 and got[8].text == "" and got[8].n_lines == 1
    assert line_dedup.dedup_lines(make_docs(TEXTS)).count() == len(TEXTS)
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_line_dedup_overlaps(make_docs):
    rows = [(1, "a\na\na\na\nb"), (2, "q\nb\nc\nd\ne\nr"), (3, "b\nc\nd\ne\nb\nc\nd")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_spans) for r in line_dedup.dedup_lines(make_docs(rows)).collect()}
    assert got == {1: ("a\nb", 3, 1), 2: ("q\nb\nc\nd\ne\nr", 0, 0), 3: ("", 7, 1)}


# -- near-duplicates


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("small,rare", [(32, 8), (2, 1), (2, 5)])
def test_near_duplicates(make_docs, monkeypatch, small, rare):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "RARE", rare)
    out = near_dedup.near_duplicates(make_docs(TEXTS)).collect()
    assert by_row(out, "doc_id", "n_shingles", "component_id", "kept") == brute_components(TEXTS)


def test_near_dedup_keeps_one(make_docs):
    docs = make_docs(TEXTS)
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    rows = Counter(r.doc_id for r in kept.collect())
    assert rows[17] == 1 and rows[18] == 0 and rows[7] == rows[8] == rows[9] == 1 and rows[12] == 1
    assert near_dedup.dedup(make_docs([])).count() == 0


# -- decontamination


def brute_leaks(rows, items, width=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for i, t in rows:
        w, hit, who = split(t), set(), set()
        for item, own in items:
            own = split(own)
            n = min(width, len(own))
            for a in range(len(own) - n + 1 if own else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == own[a : a + n]:
                        hit.update(range(p, p + n))
                        who.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(who), tuple(sorted(who))))
    return Counter(out)


ITEMS = [(1, BASE[30:140]), (2, "One, TWO three!"), (3, ""), (4, None), (10, BASE[200:320]), (None, "é"), (5, "zz yy"), (2, "One, TWO three!")]


@pytest.mark.parametrize("group_bytes", [1 << 20, 100])
def test_decontaminate(spark, make_docs, group_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [r for r in TEXTS if r[0] != 16] + [(400, "zz yy, zz-yy."), (401, "aa zz yy bb é cc")]
    out = decontaminate.decontaminate(make_docs(rows), items, group_bytes=group_bytes).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in out)
    assert got == brute_leaks(rows, ITEMS)
    text = {r.doc_id: r.text for r in out}
    assert text[400] == "." and text[401] == "aa  bb  cc" and text[7] is None and text[14] == ""
    assert decontaminate.decontaminate(make_docs([]), items).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(make_docs(rows), nothing).collect())


# -- language ID


def test_language(make_docs):
    own = random.Random(3)
    words = {"xx": ["alpha", "bravo", "charlie", "delta"], "yy": ["uno", "dos", "tres", "quatro"], "zz": ["été", "où", "ça", "noël"]}
    rows = [(i, " ".join(own.choice(words[k]) for _ in range(own.randint(3, 60))), k) for i, k in enumerate(["xx", "yy", "zz"] * 60)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !!", "yy"), (1003, "alpha delta", None), (None, "dos uno", "yy"), (5, rows[5][1], rows[5][2])]
    out = language.identify(make_docs(rows), per_class=50).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in out}
    assert [got[i] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "xx", "yy"]
    tested = [r for r in out if r.lang and r.text and any(map(str.isalpha, r.text)) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(tested) > 20 and sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert language.identify(make_docs([])).count() == 0
    assert language.identify(make_docs([(1, "abc", None)])).first().lang_pred == "und"


# -- sharding


def test_jump_shards(make_docs):
    rows = [(k % 700, "t%d" % k) for k in range(2000)] + [(None, "a"), (None, None), (3, "")]
    out = sharding.shard_documents(make_docs(rows).repartition(5), 8).collect()
    assert by_row(out, "doc_id", "size", "text_crc32") == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    shard = defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        shard[r.doc_id].add((r.shard, r.grown_shard))
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    assert all(len(v) == 1 for v in shard.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(8))
    moved = sum(r.grown_shard == 8 for r in out)
    assert 0.07 < moved / len(out) < 0.16 and max(map(len, slots.values())) < 1.4 * len(out) / 8
    assert sharding.shard_documents(make_docs([]), 8).count() == 0


def test_jump_shards_one_by_one(spark, make_docs):
    """Every shard by a plain loop of jumps over the same draws."""
    import struct

    import xxhash

    def shard(key, shards):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        at, to, step = -1, 0, 0
        while to < shards:
            at, step = to, step + 1
            draw = (xxhash.xxh64(struct.pack("<i", step), seed=seed).intdigest() >> 33) + 1
            to = int((at + 1) * 2147483648.0 / draw)
        return at

    keys = [None, 0, 1, -1, 2**63 - 1, -(2**63), *range(2, 400)]
    docs = make_docs([(k, "t") for k in keys])
    for n in (1, 2, 8, 37):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs, n).collect()}
        assert got == {k: (shard(k, n), shard(k, n + 1)) for k in keys}
