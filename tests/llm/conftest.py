import datetime

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names operators use themselves
        T.StructField("n", T.LongType()),
        T.StructField("score", T.DateType()),
        T.StructField("n_lines", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("items", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows with clashing extra columns."""

    def make(rows):
        day = datetime.date(2020, 1, 2)
        return spark.createDataFrame(
            [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 1, 2, day, "x", "y", None, "z") for r in rows], DOCS
        )

    return make


@pytest.fixture
def sf_docs(make_docs, tmp_path):
    """A folder of tables that holds these documents, and the documents."""

    def make(rows):
        docs = make_docs(rows)
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path), docs

    return make
