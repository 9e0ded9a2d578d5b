"""Operator 13, fill-in-middle: a text is cut at two unit boundaries that a wavelet matrix locates.

Each byte of a group of texts gets a class; the ranks of the classes that open a unit add up to the
number of units before any byte, and bisection on that count finds the byte of a cut.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planmill.llm.rows import fresh
from planmill.llm.segments import in_parts
from planmill.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
GROUP_BYTES = 1 << 22
#: Byte classes: continuation; white space; first of a word; the same two at the head of a line; the
#: other characters of a word.
_CONTINUED, _SPACE, _WORD, _LINE_SPACE, _LINE_WORD, _WORD_ON = range(6)
#: Classes that open a unit.
UNITS = {
    "chars": (_SPACE, _WORD, _LINE_SPACE, _LINE_WORD, _WORD_ON),
    "words": (_WORD, _LINE_WORD),
    "lines": (_LINE_SPACE, _LINE_WORD),
}


def byte_classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each byte of texts that lie one after the other, beginning at `starts`.

    A word is a run of characters other than white space (blank, tab to carriage return); a line ends
    with its line feed.
    """
    out = np.empty(len(data), np.uint8)
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    for begin in range(0, len(data), GROUP_BYTES):
        own = data[begin : begin + GROUP_BYTES]
        ahead = np.append(data[begin - 1 : begin] if begin else np.uint8(10), own[:-1])
        here = first[begin : begin + len(own)]
        space, line = _blank(own), here | (ahead == 10)
        word = ~space & (here | _blank(ahead))
        kind = np.full(len(own), _WORD_ON, np.uint8)
        kind[space] = _SPACE
        kind[space & line] = _LINE_SPACE
        kind[word] = _WORD
        kind[word & line] = _LINE_WORD
        kind[(own & 0xC0) == 0x80] = _CONTINUED
        out[begin : begin + len(own)] = kind
    return out


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def locate(data: np.ndarray, offsets: np.ndarray, units: str, draws: np.ndarray):
    """(units of each text, its two cuts in units, their bytes): cut = draw modulo (units + 1), in order.

    Unit k begins at byte `find(k + 1) - 1`; the cut after all units is the end of the text.
    """
    opens = UNITS[units]
    matrix = WaveletMatrix(byte_classes(data, offsets[:-1][np.diff(offsets) > 0]), 3)
    before = matrix.count(opens, offsets)
    n = np.diff(before)
    cuts = np.sort(draws % (n + 1)[:, None], axis=1)
    places = []
    for side in (0, 1):
        k = cuts[:, side]
        at = matrix.find(opens, before[:-1] + np.minimum(k + 1, n), offsets[:-1], offsets[1:])
        places.append(np.where(k == n, offsets[1:], at - 1))
    return n, cuts, np.stack(places, axis=1)


def _groups(texts: list[bytes]):
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def draws_of(key: Column, salt: str) -> list[Column]:
    """Four unsigned 32-bit draws: the first groups of 8 digits of the hex sha256 of `salt:key`.

    A null key counts as an empty one.
    """
    digits = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame, salt: str = "1", units: str = "chars", plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each whole text as a fill-in-middle example.

    Both cuts lie between any two of the n units (`chars`: code points, `words`, `lines`), as the draws of
    the doc_id say. Form `psm` is prefix, suffix, middle, each behind its mark; `spm` is suffix, prefix,
    middle; `plain` is the text itself: `plain_percent` of the texts, empty ones and those that hold a
    mark already. prefix_chars and middle_chars count units and are null if plain. Null text: empty. Rows
    that share a doc_id are cut alike; a null doc_id draws as an empty key; an empty table gives no rows.
    Only doc_id and text are read. Texts are cut in groups of about 4 MB; a longer one is a group of its own.
    """
    if units not in UNITS:
        raise ValueError(f"units: one of {sorted(UNITS)}")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws_of(F.col("doc_id"), salt), 1)],
    )

    def rows(batches):
        p, s, m = marks
        for batch in in_parts(batches, 1024):
            texts = batch.column(1).to_pylist()
            draws = np.stack([batch.column(c).to_numpy() for c in (2, 3, 4, 5)], axis=1)
            for begin, own in _groups(texts):
                h = draws[begin : begin + len(own)]
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in own])])
                n, cuts, places = locate(np.frombuffer(b"".join(own), np.uint8), offsets, units, h[:, :2])
                places -= offsets[:-1, None]
                plain = (h[:, 2] % 100 >= 100 - plain_percent) | np.array([not t or any(k in t for k in marks) for t in own])
                spm = h[:, 3] % 100 < spm_percent
                out, forms = [], []
                for t, (a, b), keep, last in zip(own, places.tolist(), plain.tolist(), spm.tolist(), strict=True):
                    if keep:
                        out.append(t)
                        forms.append("plain")
                    elif last:
                        out.append(b"".join([s, t[b:], p, t[:a], m, t[a:b]]))
                        forms.append("spm")
                    else:
                        out.append(b"".join([p, t[:a], s, t[b:], m, t[a:b]]))
                        forms.append("psm")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(own)), pa.array(n), pa.array(forms),
                        pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain),
                        pa.array(out, pa.binary()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    fields = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary"
    return drawn.mapInArrow(rows, fields).withColumn("output", F.col("output").cast("string"))


def restore(examples: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from output and form alone; all columns stay.

    A text that is not plain holds no mark, so each mark stands once in its output.
    """
    (parts,) = fresh(examples, "_parts")
    split = examples.withColumn(parts, F.split("output", f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1))
    at = lambda i: F.get(parts, F.lit(i))
    text = (
        F.when(F.col("form") == "psm", F.concat(at(1), at(3), at(2)))
        .when(F.col("form") == "spm", F.concat(at(2), at(3), at(1)))
        .otherwise(F.col("output"))
    )
    return split.withColumn("restored", text).drop(parts)
