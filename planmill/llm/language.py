"""Operator 4, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed runs of 1 to 3 characters of the lower-cased text, other characters than letters
read as one space. Document frequencies count all documents that may be learned from. The weights
are fitted on a bounded sample (`per_class` different texts of each language) by
follow-the-regularised-leader with elastic-net penalties; a part of the sample held back from the
weights sets the temperature.
"""

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmill.llm.segments import in_parts, text_groups

BITS = 13
SIZE = 1 << BITS
PER_CLASS = 1000
GROUP_CHARS = 1 << 18
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts: texts x SIZE, whether each text has a letter)."""
    lowered = [t.lower() for t in texts]
    lens = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    row = np.repeat(np.arange(len(texts)), lens)
    lead = np.ones(len(points), bool)
    lead[1:] = row[1:] != row[:-1]
    keep = letter.copy()  # of a run of other characters the first stays
    keep[1:] |= letter[:-1]
    keep |= lead
    points, row = np.where(letter, points, 32)[keep].astype(np.uint32), row[keep]
    out = np.zeros(len(texts) * SIZE, np.float32)
    if len(points):
        code = points * np.uint32(0x9E3779B1)
        gram = code
        for n in (1, 2, 3):
            if n > 1:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[n - 1 :]
            same = row[: len(gram)] == row[n - 1 :]
            mixed = (gram ^ (gram >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
            at = row[: len(gram)] * SIZE + (mixed >> np.uint32(32 - BITS)).astype(np.int64)
            out += np.bincount(at[same], minlength=len(out))
    has = np.bincount(row[points != 32], minlength=len(texts)) > 0
    return out.reshape(len(texts), SIZE), has


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log(1 + count) * idf with length 1, and a constant feature at the end."""
    x = np.log1p(tf) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x / np.maximum(norm, 1e-12)
    return np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows, target: np.ndarray, classes: int, epochs=5, batch=32, alpha=0.5, beta=1.0, l1=0.002, l2=0.002) -> np.ndarray:
    """Weights (SIZE + 1, classes) by follow-the-regularised-leader, per coordinate.

    `rows(index array)` gives feature rows. A coordinate stays 0 while |z| <= l1; the constant
    feature has no penalty.
    """
    z = np.zeros((SIZE + 1, classes))
    n = np.zeros_like(z)
    w = np.zeros_like(z)
    flat1, flat2 = np.full((SIZE + 1, 1), l1), np.full((SIZE + 1, 1), l2)
    flat1[-1] = flat2[-1] = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        perm = order.permutation(len(target))
        for begin in range(0, len(perm), batch):
            own = perm[begin : begin + batch]
            x = rows(own)
            error = softmax(x @ w)
            error[np.arange(len(own)), target[own]] -= 1
            g = x.T @ error / len(own)
            more = n + g * g
            z += g - (np.sqrt(more) - np.sqrt(n)) / alpha * w
            n = more
            w = np.where(np.abs(z) <= flat1, 0.0, -(z - np.sign(z) * flat1) / ((beta + np.sqrt(n)) / alpha + flat2))
    return w


def temperature(scores: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the scores that makes the target most likely; golden section over its log."""
    if not len(target):
        return 1.0

    def loss(t):
        p = softmax(scores / np.exp(t))[np.arange(len(target)), target]
        return -np.log(np.maximum(p, 1e-300)).mean()

    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        tf, has = counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(weigh(tf, self.idf) @ self.weights / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist(), strict=True)]
        return names, np.where(has, p.max(axis=1), 0.0)


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(texts with each feature, number of texts) over the whole column `text`."""

    def run(batches):
        df, total = np.zeros(SIZE, np.int64), 0
        for batch in in_parts(batches):
            for group in text_groups(batch.column(0).to_pylist(), GROUP_CHARS):
                df += (counts(group)[0] > 0).sum(axis=0)
                total += len(group)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, SIZE), pa.int32()), pa.array(np.append(total, df), pa.int64())],
            ["feature", "n"],
        )

    summed = texts.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r.feature: r.n for r in summed.collect()}
    return np.array([found.get(i, 0) for i in range(SIZE)], np.int64), found.get(-1, 0)


def sample(docs: DataFrame, per_class: int) -> list:
    """Up to `per_class` different texts of each language, those of the smallest text hashes."""
    keyed = docs.select("lang", "text", F.xxhash64("text").alias("h"))
    keys = keyed.select("lang", "h").distinct()
    sizes = {r.lang: r["count"] for r in keys.groupBy("lang").count().collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, 2.0 * per_class / n))])
    near = keys.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < F.try_element_at(share, F.col("lang")))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = ranked.filter(F.col("r") <= per_class).select("lang", "h")
    # at most per_class keys of each language
    texts = keyed.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                tf = counts([batch.column("text")[i].as_py()])[0][0]
                at = np.flatnonzero(tf)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": batch.column("lang").slice(i, 1),
                        "h": batch.column("h").slice(i, 1),
                        "at": pa.array([at.astype("<i4").tobytes()], pa.binary()),
                        "tf": pa.array([tf[at].astype("<f4").tobytes()], pa.binary()),
                    }
                )

    rows = texts.mapInArrow(run, "lang string, h bigint, at binary, tf binary").collect()
    return sorted(rows, key=lambda r: (r.lang, r.h))


def train(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of the languages of `docs` (text, lang); rows without text or lang are left out."""
    docs = docs.select("text", F.col("lang").cast("string").alias("lang")).dropna()
    rows = sample(docs, per_class)
    df, total = document_frequency(docs)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    languages = sorted({r.lang for r in rows})
    if not rows:
        return Model([], idf, np.zeros((SIZE + 1, 0)), 1.0)
    target = np.array([languages.index(r.lang) for r in rows])
    held = np.array([r.h % 10 == 0 for r in rows])
    if held.all() or len(set(target[~held])) < len(languages):
        held[:] = False

    def dense(index):
        tf = np.zeros((len(index), SIZE), np.float32)
        for i, k in enumerate(index):
            tf[i, np.frombuffer(rows[k].at, "<i4")] = np.frombuffer(rows[k].tf, "<f4")
        return weigh(tf, idf)

    learn, check = np.flatnonzero(~held), np.flatnonzero(held)
    weights = fit(lambda own: dense(learn[own]), target[learn], len(languages))
    scores = [dense(check[b : b + 64]) @ weights for b in range(0, len(check), 64)]
    divisor = temperature(np.concatenate(scores), target[check]) if scores else 1.0
    return Model(languages, idf, weights, divisor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score to all columns of `docs`; columns of these names give way.

    A null text, or one without a letter, has lang_pred `und` and score 0, and so has every text
    where nothing was learned. Texts are read whole; an empty table gives no rows; repeated rows
    have equal results; equal probabilities go to the first language by name.
    """
    docs = docs.drop("lang_pred", "score")
    columns = list(docs.columns)
    at = columns.index("text")

    def run(batches):
        for batch in in_parts(batches):
            begin = 0
            for group in text_groups(batch.column(at).to_pylist(), GROUP_CHARS):
                names, scores = model.predict(group)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(begin, len(group)).columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    [*columns, "lang_pred", "score"],
                )
                begin += len(group)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is never learned from: crc32 of its id as text, modulo 5; null: as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Train on the documents that are not held out, predict for all; adds lang_pred and score."""
    return predict(docs, train(docs.filter(~held_out()), per_class))
