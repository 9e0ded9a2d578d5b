import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from planmill.llm import decontaminate
from planmill.llm.rows import read_small_file

from tests.llm.test_texts import BASE, TEXTS, brute_components, brute_leaks, brute_repeats  # noqa: F401


def test_registered():
    queries = entry.queries()
    numbers = {int(k[2:].split("_")[0]) for k in queries if k.startswith("op") and k[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in queries
    assert public_tokenizers.path("byte_bpe_50k.json")


def test_stages(spark, make_docs, tmp_path):
    items = [(1, BASE[30:140])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(*r, "xx") for r in TEXTS if r[0] != 16] + [(500, "12 34", "xx"), (501, "some words", None)]
    docs = make_docs(rows)
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minmax_dedup", "decontaminate", "bpe_codec"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) == sum(any(map(str.isalpha, r.text or "")) for r in before)
            assert all(r.lang == "xx" for r in after)
        elif name == "line_dedup":
            assert len(after) == len(before)
        elif name == "minmax_dedup":
            found = brute_components([(r.doc_id, r.text) for r in before])
            kept = [k for k, n in found.items() if k[3] for _ in range(1 if k[1] else n)]
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted((k[0] is None, k[0] or 0) for k in kept)
        elif name == "decontaminate":
            assert len(after) == len(before)
            leaks = brute_leaks([(r.doc_id, r.text) for r in after], items)
            assert all(k[2] == 0 for k in leaks)
            clean = {r.doc_id: r.text for r in before}
            hit = {k[0] for k in brute_leaks([(r.doc_id, r.text) for r in before], items) if k[2]}
            assert hit and all(r.text == clean[r.doc_id] for r in after if r.doc_id not in hit)
        else:
            raw = read_small_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            want = Counter()
            for r in before:
                ids = np.array(library.encode_ordinary(r.text or ""), "<u4").tobytes()
                want[r.doc_id, len(ids) // 4, ids, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
            assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in after) == want


def test_run(spark, make_docs, tmp_path):
    docs = make_docs([(*r, "xx") for r in TEXTS if r[0] != 16]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, BASE[30:140])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert decontaminate.WINDOW == 10
