"""SentencePiece, fill-in-middle and wavelet ranks against the library and brute force."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planmill.llm import fill_middle, piece_bpe, queries
from planmill.llm.rows import read_small_file
from planmill.llm.wavelet import WaveletMatrix

rng = random.Random(11)
ALPHABET = " a b  e t\n▁é中😀\x00\t,.<0x41>thingou　﻿"
TEXTS = [
    (None, None), (None, "no id"), (1, None), (2, ""), (3, " "), (4, "  \n "), (5, "▁▁ x▁y"), (6, "same"), (6, "same"),
    (7, "a<P>b"), (8, "<S"), (9, "<P<S<M"), (10, "ü" * 70), (11, "thing " * 40000), (12, "中文😀" * 500),
    (13, "one\ntwo three\n\n four"), (14, "<M> twice <M>"), (15, "M>"), (16, "\x00"),
] + [(100 + k, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90)))) for k in range(200)]


@pytest.fixture(scope="module")
def model():
    return read_small_file(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pieces(model):
    return piece_bpe.PieceModel(model)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- SentencePiece


def test_round_trip_is_the_librarys(spark, make_docs, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = piece_bpe.round_trip(make_docs(TEXTS).repartition(3), model)
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in out.collect())
    ids = [(str(d), library.encode(t or "")) for d, t in TEXTS]
    assert got == sorted((d, i, library.decode(i)) for d, i in ids)
    again = piece_bpe.decode(piece_bpe.encode(make_docs(TEXTS), model).withColumn("n", F.lit(1)), model)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in again.collect()) == got


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=ALPHABET + "qxz0123", max_size=80))
def test_ids_of_any_text(pieces, text):
    segments = pieces.segments(text, True)
    expected = pieces.library.encode(text)
    assert [i for s in segments for i in pieces.merge(s)] == expected
    assert pieces.merge_all(segments)[0].tolist() == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(3, 258) | st.sampled_from([0, 1, 2, 259, 264, 243, 162, 155]), max_size=9))
def test_decode_any_ids(pieces, ids):
    assert pieces.decode(np.array(ids, np.int64)) == pieces.library.decode(ids)


def test_stretches_and_heaps_change_nothing(pieces, monkeypatch):
    texts = [t or "" for _, t in TEXTS if len(t or "") < 5000]
    codes = piece_bpe.SegmentCodes(pieces.merge_all, 50)
    whole, lens = piece_bpe._encode_group(texts, codes, pieces, True)
    monkeypatch.setattr(piece_bpe, "STRETCH_CHARS", 5)
    monkeypatch.setattr(piece_bpe, "SHORT", 2)
    cut, cut_lens = piece_bpe._encode_group(texts, piece_bpe.SegmentCodes(pieces.merge_all, 50), pieces, True)
    assert whole.tolist() == cut.tolist() and lens.tolist() == cut_lens.tolist()


def test_a_difference_from_the_library_is_an_error(pieces):
    with pytest.raises(AssertionError, match="differ"):
        pieces.check(["ab c"], [True], [np.array([5, 6])])
    with pytest.raises(ValueError, match="keep characters"):
        pieces.library, own = sentencepiece.SentencePieceProcessor(), pieces.library
        try:
            pieces.library = type("Lower", (), {"normalize": staticmethod(str.lower)})
            pieces._expect_plain_normaliser()
        finally:
            pieces.library = own


def test_piece_codec_without_rows(spark, make_docs, model):
    assert piece_bpe.round_trip(make_docs([]), model).collect() == []


def test_piece_query(spark, sf_docs, model):
    folder, docs = sf_docs(TEXTS)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = sorted(map(tuple, queries.op11_piece_codec(spark, folder).collect()), key=str)
    want = []
    for d, t in TEXTS:
        ids = library.encode(t or "")
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)


# -- wavelet matrix and fill-in-middle


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300), st.integers(0, 7))
def test_ranks(symbols, symbol):
    row = np.array(symbols, np.uint8)
    matrix = WaveletMatrix(row, 3)
    at = np.arange(len(row) + 1)
    expected = [int((row[:k] == symbol).sum()) for k in at]
    assert matrix.rank(symbol, at).tolist() == expected
    some = [symbol, (symbol + 3) % 8]
    both = [int(np.isin(row[:k], some).sum()) for k in at]
    assert matrix.count(some, at).tolist() == both
    wanted = np.arange(both[-1] + 1)
    zero, end = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(row))
    assert matrix.find(some, wanted, zero, end).tolist() == [both.index(w) for w in wanted]


def example(doc_id, text, units=lambda t: list(t)):
    """The contract, said plainly: (n, form, prefix units, middle units, output)."""
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    parts = units(text)
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("group", [40, 1 << 22])
def test_fill_middle(spark, make_docs, monkeypatch, group):
    monkeypatch.setattr(fill_middle, "GROUP_BYTES", group)
    out = fill_middle.restore(fill_middle.transform(make_docs(TEXTS).repartition(2))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str)
    assert got == sorted(((d, *example(d, t)) for d, t in TEXTS), key=str)
    assert sorted((str(r.doc_id), r.restored) for r in out) == sorted((str(d), t or "") for d, t in TEXTS)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def lines_of(text):
    rows = text.split("\n")
    return [r + "\n" for r in rows[:-1]] + rows[-1:] * (rows[-1] != "")


def test_cuts_between_lines_and_words(spark, make_docs):
    texts = [(d, t) for d, t in TEXTS if t and "\x00" not in t]
    got = {(r.doc_id, r.output): (r.n, r.form, r.prefix_chars, r.middle_chars) for r in
           fill_middle.transform(make_docs(texts), units="lines").collect()}
    for d, t in texts:
        n, form, a, m, out = example(d, t, lines_of)
        assert got[d, out] == (n, form, a, m)
    rows = fill_middle.restore(fill_middle.transform(make_docs(texts), units="words")).collect()
    import re

    assert sorted((str(r.doc_id), r.n) for r in rows) == sorted((str(d), len(re.findall(r"[^ \t-\r]+", t))) for d, t in texts)
    assert sorted((str(r.doc_id), r.restored) for r in rows) == sorted((str(d), t) for d, t in texts)
    with pytest.raises(ValueError, match="units"):
        fill_middle.transform(make_docs(texts), units="pages")


def test_fill_middle_query(spark, sf_docs):
    folder, _ = sf_docs(TEXTS)
    got = sorted(map(tuple, queries.op13_fill_middle(spark, folder).collect()), key=str)
    want = []
    for d, t in TEXTS:
        n, form, a, m, out = example(d, t)
        want.append((d, n, form, a, m, sha(out), sha(t or "")))
    assert got == sorted(want, key=str)
    assert fill_middle.transform(spark.read.parquet(f"{folder}/documents.parquet").limit(0)).collect() == []
