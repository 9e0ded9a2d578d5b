"""Operator 2, exact top-k search: term-at-a-time accumulation in dense score arrays.

Queries and candidates are dealt into blocks by a hash of their id; each pair of blocks is one
group. In a group every dimension is a posting list of (candidate, weight), and its weighted
postings are scattered into the score arrays of all queries that use the dimension. The best k of
each score array are selected there, and the groups' winners merge by rank.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 4096
QUERIES = 1024
AT_ONCE = 64

Key = tuple[pa.Scalar, ...]


def _scaled(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) of each value: int64, or exact Python integers where one is beyond 2^53."""
    if not len(values) or np.abs(values).max() < 2.0**53:
        return np.floor(64.0 * values).astype(np.int64)
    return np.array([64 * int(x) if abs(x) >= 2.0**53 else math.floor(64.0 * x) for x in values.tolist()], object)


def _fits(one: np.ndarray, two: np.ndarray, terms: int) -> bool:
    """Whether sums of `terms` products of the two weights stay within int64."""
    most = lambda w: max((abs(int(w.min())), abs(int(w.max()))), default=0) if len(w) else 0
    return most(one) * most(two) * max(terms, 1) < 1 << 62


def _postings(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, weight) of all components that are not 0."""
    array = lists.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0)
    lens = np.diff(array.offsets.to_numpy())
    row = np.repeat(np.arange(len(lens)), lens)
    dim = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    weight = _scaled(array.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    used = weight != 0
    return row[used], dim[used], weight[used]


def _by_dimension(row, dim, weight, n_dims) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(dim, kind="stable")
    cuts = np.searchsorted(dim[order], np.arange(1, n_dims))
    return list(zip(np.split(row[order], cuts), np.split(weight[order], cuts), strict=True))


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id; ids ascend, `own` is left out."""
    others = ids != own
    found = np.flatnonzero(others)
    if scores.dtype == object:
        return np.array(sorted(found.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(found) > k:
        values = scores[found]
        least = np.partition(values, len(values) - k)[len(values) - k]
        found = found[values >= least]
    return found[np.lexsort((ids[found], -scores[found]))][:k]


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key: Key, table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        rows, queries = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        if not len(rows) or not len(queries):
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        posting, wanted = _postings(rows.column("v")), _postings(queries.column("v"))
        n_dims = 1 + max([0, *posting[1][-1:].tolist(), *(x.max() for x in (posting[1], wanted[1]) if len(x))])
        # Sums that could leave int64 are made of Python integers in this pair of blocks.
        kind = np.int64 if _fits(posting[2], wanted[2], n_dims) else object
        posting, wanted = (*posting[:2], posting[2].astype(kind)), (*wanted[:2], wanted[2].astype(kind))
        lists = _by_dimension(*posting, n_dims)
        out = ([], [], [])
        for begin in range(0, len(query_ids), AT_ONCE):
            own = (wanted[0] >= begin) & (wanted[0] < begin + AT_ONCE)
            terms = _by_dimension(wanted[0][own] - begin, wanted[1][own], wanted[2][own], n_dims)
            block = query_ids[begin : begin + AT_ONCE]
            scores = np.zeros((len(ids), len(block)), kind)
            for (candidate, weight), (query, factor) in zip(lists, terms, strict=True):
                if not len(candidate) or not len(query):
                    continue
                line = np.zeros(len(block), kind)
                line[query] = factor
                if len(candidate) == len(ids):
                    scores += weight[:, None] * line
                else:
                    scores[candidate] += weight[:, None] * line
            for q, query_id in enumerate(block.tolist()):
                column = np.ascontiguousarray(scores[:, q])
                best = _best(column, ids, query_id, k)
                if kind is object and any(not -(1 << 63) <= v < 1 << 63 for v in column[best].tolist()):
                    raise OverflowError(f"a score of query {query_id} has no 64-bit integer")
                out[0].append(np.full(len(best), query_id))
                out[1].append(ids[best])
                out[2].append(column[best])
        return pa.table([np.concatenate(c).astype(np.int64) for c in out], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 20, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query, all if fewer.

    vectors: vec_id, embedding. A component x counts as floor(64 * x); the score is the integer inner
    product; a shorter vector has zeros beyond its end; ties go to the smaller vec_id. Vectors that
    are null or hold null or non-finite components take no part, nor do rows without vec_id. Of rows
    that share a vec_id the smallest vector (by components in order) stands for all. An empty table,
    or one without queries, gives no rows. Components and sums of any size are exact; a score among the k
    highest that no 64-bit integer can hold is an OverflowError.
    """
    good = vectors.filter(
        "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null"
        " and not isnan(x) and abs(x) < cast('Infinity' as double))"
    )
    rows = good.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min("embedding").alias("v"))
    asked = rows.filter(is_query)
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    row_blocks, query_blocks = max(1, -(-n.n // candidates)), max(1, -(-n.q // queries))
    row_block = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = rows.select("vec_id", "v", F.lit(False).alias("is_query"), row_block.alias("rb"), numbers(query_blocks).alias("qb")).union(
        asked.select("vec_id", "v", F.lit(True).alias("is_query"), numbers(row_blocks).alias("rb"), query_block.alias("qb"))
    )
    found = dealt.groupBy("rb", "qb").applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
