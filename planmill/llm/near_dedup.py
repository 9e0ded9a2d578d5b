"""Operator 9, MinHash near-dedup: min-max signatures, bands, exact links, components.

Rows with equal shingle sets are one node from the first step on, so exact copies cost nothing
later. Nodes that agree in a band are candidates:

1. every member is compared with two hubs of its bucket, and links join into components;
2. only pairs of different components that share a bucket are left. Buckets of up to SMALL members
   give these directly. For members of larger buckets, shingles that at most RARE of them have are
   looked up: pairs that share such a shingle are few; pairs that share none can have at most their
   other shingles in common, and those whose sizes rule out the similarity are dropped unseen.

Both ways are exact for the candidates of the bands, and every link is confirmed on whole sets. The
conditions of step 2 stand inside a join of the bucket with itself: they keep pairs from its result,
but a large bucket that still spans several components has all its pairs formed on its one key.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.llm.components import components
from planmill.llm.rows import fresh, settle
from planmill.llm.segments import in_parts, text_groups
from planmill.llm.shingles import band_keys, shingle_sets
from planmill.session import cut_lineage

GROUP_CHARS = 1 << 18
SMALL = 32
#: Bits of the marks that keep other texts out of the join of `_sets`; at most SLOTS / 64 rows are broadcast.
SLOTS = 1 << 22
RARE = 8


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n, node, bands): set size, 16-byte set key (null: no words), band keys."""

    def run(batches):
        for batch in in_parts(batches):
            begin = 0
            for group in text_groups(batch.column(2).to_pylist(), GROUP_CHARS):
                sets = shingle_sets(group)
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(some).astype("<i8").tolist()) if some else iter(())
                part = batch.slice(begin, len(group))
                begin += len(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "content", "n", "node", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("content"), "text").mapInArrow(
        run, f"doc_id {kind}, content bigint, n bigint, node binary, bands array<bigint>"
    )


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, shingles) of the named nodes (id, content), from the text of one document of each."""

    def run(batches):
        for batch in in_parts(batches):
            begin = 0
            for group in text_groups(batch.column(1).to_pylist(), GROUP_CHARS):
                sets = shingle_sets(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(group)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    ["id", "shingles"],
                )
                begin += len(group)

    slot = F.pmod("content", F.lit(SLOTS))
    marks = (
        nodes.select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("mask"))
    )
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("content"), "text").withColumn("slot", slot)
    near = keyed.join(F.broadcast(marks), F.expr("slot div 64") == F.col("word")).filter(
        "mask & shiftleft(1L, cast(slot % 64 as int)) != 0"
    )
    texts = near.join(nodes.select("id", "content"), "content").select("id", "text")
    return texts.mapInArrow(run, "id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common >= percent * united shingles, on whole sets."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))

    def run(batches):
        for batch in batches:
            one, two = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = one[i].values.to_numpy(), two[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _fits(n: str, m: str, percent: int):
    """Whether two sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _crossing(members: DataFrame, percent: int, *conditions) -> DataFrame:
    """Pairs (a, b) of one bucket and two components that fit by size and meet the conditions.

    `keys` has all buckets of a member; a pair comes from the smallest one that both are in.
    """
    columns = ("id", "n", "root", "rare", "keys")
    one = members.select("key", *[F.col(c).alias(c + "1") for c in columns])
    two = members.select("key", *[F.col(c).alias(c + "2") for c in columns])
    wanted = (F.col("id1") < F.col("id2")) & (F.col("root1") != F.col("root2")) & _fits("n1", "n2", percent)
    for c in conditions:
        wanted = wanted & c
    once = F.array_min(F.array_intersect("keys1", "keys2")) == F.col("key")
    return one.join(two, "key").filter(wanted & once).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def _with_keys(members: DataFrame) -> DataFrame:
    """Adds `keys`, the buckets of a member among those named (as many as bands or rare shingles)."""
    return members.join(members.groupBy("id").agg(F.collect_list("key").alias("keys")), "id")


def _rare_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(key: shingle, id, df) for the shingles that 1 to RARE of the nodes have.

    Up to three owners follow from the smallest, the largest and the exclusive or of all owners, so
    that the many shingles of one owner need no join.
    """
    tokens = sets.join(nodes, "id").select("id", F.explode("shingles").alias("key"))
    found = cut_lineage(
        tokens.groupBy("key")
        .agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("low"), F.max("id").alias("high"), F.expr("bit_xor(id)").alias("all"))
        .filter(F.col("df") <= RARE)
    )
    owners = F.expr("case df when 1 then array(low) when 2 then array(low, high) else array(low, high, all ^ low ^ high) end")
    few = found.filter("df <= 3").select("key", F.explode(owners).alias("id"), "df")
    more = tokens.join(found.filter("df > 3").select("key", "df"), "key").select("key", "id", "df")
    return few.union(more)


def _left_over(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket, lie in different components and may still be similar."""
    placed = members.join(roots, "id", "left").select(
        "key", "id", "n", F.coalesce("root", "id").alias("root"), F.lit(0).cast("bigint").alias("rare")
    )
    open_ = (
        placed.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
        .filter("low != high")
        .select("key", "size")
    )
    placed = settle(placed.join(open_, "key"))
    direct = _crossing(_with_keys(placed.filter(F.col("size") <= SMALL)), percent)

    large = placed.filter(F.col("size") > SMALL)
    nodes = large.select("id", "n", "root").distinct()
    rare = settle(_rare_shingles(nodes.select("id"), sets))
    shared = rare.filter("df > 1").join(nodes, "id").select("key", "id", "n", "root", F.lit(0).alias("rare"))
    sharing = _crossing(_with_keys(shared), percent)
    counts = rare.groupBy("id").agg(F.count(F.lit(1)).alias("rare"))
    ranked = large.drop("rare").join(counts, "id", "left").na.fill(0, ["rare"])
    common = F.least(F.col("n1") - F.col("rare1"), F.col("n2") - F.col("rare2"))
    possible = 100 * common >= percent * (F.col("n1") + F.col("n2") - common)
    without = _crossing(_with_keys(ranked), percent, possible)
    return direct.union(sharing).union(without).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, content, n_shingles, component_id, kept) for every row of `docs`.

    Documents are linked at 100 * common >= percent * united five-word shingles; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have no shingles and no links.
    Repeated rows and rows that share a doc_id are members like others; rows with a null doc_id link
    but give no component_id while another member has an id. kept: doc_id = component_id (both may be
    null). content is a hash of doc_id and text. An empty table gives no rows.
    """
    rows = cut_lineage(signatures(docs))
    nodes = cut_lineage(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc"), F.min("content").alias("content"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    banded = nodes.select("id", "doc", "n", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("doc"), F.max("id").alias("most"))
        .filter("size > 1")
        .drop("size")
    )
    # the hubs are the member of the smallest doc_id and, if that is no other, the last
    members = settle(
        banded.join(buckets.withColumnRenamed("doc", "first"), "key").select("key", "id", "n", "most", F.col("doc").eqNullSafe(F.col("first")).alias("leads"))
    )
    involved = nodes.join(members.select("id").distinct(), "id", "left_semi")
    sets = cut_lineage(_sets(docs, involved).dropDuplicates(["id"]))

    sizes = involved.select("id", "n")
    leaders = members.filter("leads").groupBy("key").agg(F.min("id").alias("hub"))
    hubs = members.join(leaders, "key").select("id", "hub").union(members.select("id", F.col("most").alias("hub")))
    star = settle(
        hubs.filter("id != hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
        .join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n1")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("n2")), "b")
        .filter(_fits("n1", "n2", percent))
        .select("a", "b")
    )
    links = settle(confirmed(star, sets, percent))
    others = _left_over(members.select("key", "id", "n"), sets, settle(components(links)).withColumnRenamed("node", "id"), percent)
    more = confirmed(others.join(star, ["a", "b"], "left_anti"), sets, percent)
    roots = settle(components(links.union(more)))

    placed = nodes.select("id", "node", "doc").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = placed.join(least, "root").select("node", "component_id")
    out = rows.drop("bands").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "content", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The kept documents, one row of each group; all columns stay.

    Where the kept document stands in several equal rows, one of them stays. Rows without words are
    in no group and all stay.
    """
    content, key, id_, copies, size = fresh(docs, "_content", "_key", "_id", "_copies", "_size")
    kept = (
        near_duplicates(docs, percent)
        .filter("kept")
        .groupBy(F.col("doc_id").alias(id_), F.col("content").alias(key))
        .agg(F.count(F.lit(1)).alias(copies), F.max("n_shingles").alias(size))
    )
    joined = docs.withColumn(content, F.xxhash64("doc_id", "text")).join(
        kept, (F.col(content) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_))
    )
    again = (F.col(copies) > 1) & (F.col(size) > 0)
    several = joined.filter(again).dropDuplicates([content])
    return joined.filter(~again).union(several).select(*[F.col(f"`{c}`") for c in docs.columns])
