"""A training corpus from `documents`, in five stages; each is written and read again by the next.

1. language ID: documents without text, or without a letter, go; a missing `lang` is filled in;
2. line dedup: lines of repeated three-line windows go, but for their first occurrence;
3. near-duplicates: one document of each group stays, that of the smallest doc_id;
4. benchmark decontamination: words inside benchmark windows go;
5. byte-level BPE: ids of the whole remaining text, decoded again to prove the round trip.

All but the last stage return the columns of their documents. A document whose lines or words all go
stays, with what is left of its text.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmill.llm import bpe, decontaminate, language, line_dedup, near_dedup
from planmill.llm.rows import read_small_file, table
from planmill.session import shared_folder


def _guarded(docs: DataFrame, operator) -> DataFrame:
    """operator(docs) with the columns of docs only, whatever extra columns are called."""
    names = docs.columns
    plain = [c if c in ("doc_id", "text", "lang") else f"_column{i}" for i, c in enumerate(names)]
    return operator(docs.toDF(*plain)).select(*[F.col(p).alias(c) for p, c in zip(plain, names, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; `lang` is kept where it is set and predicted where it is null.

    The model learns from the documents of this stage that are not held out.
    """
    model = language.train(docs.filter(~language.held_out()))

    def accepted(rows: DataFrame) -> DataFrame:
        found = language.predict(rows, model).filter(F.col("lang_pred") != language.UNKNOWN)
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return _guarded(docs, accepted)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows."""
    return _guarded(docs, line_dedup.dedup_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return _guarded(docs, near_dedup.dedup)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    items = table(spark, sf_dir, "benchmark")
    return _guarded(docs, lambda rows: decontaminate.decontaminate(rows, items))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256); ids are little-endian unsigned 32-bit."""
    ranks = read_small_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("minmax_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("bpe_codec", token_ids),
]

#: Language ID and BPE are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result goes to the shared folder and is read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus")
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
