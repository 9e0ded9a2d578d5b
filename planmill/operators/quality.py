"""Splits, validation, audits and samples."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from planmill.constants import DIRECTIONS, TEST_RATIO, VAL_RATIO
from planmill.functions.draws import u
from planmill.session import cut_lineage

_BUCKETS = 65536


def split_by_hash(df: DataFrame, key="plan_id", val=VAL_RATIO, test=TEST_RATIO, seed=42) -> DataFrame:
    """`split` from a hash of the key alone: no shuffle, ratios hold on average."""
    d = u("split", seed=seed, variant="0", plan=key)
    return df.withColumn("_u", F.expr(d)).withColumn(
        "split",
        F.when(F.col("_u") < test, "test").when(F.col("_u") < test + val, "validation").otherwise("train"),
    ).drop("_u")


def split_exact(df: DataFrame, key="plan_id", val=VAL_RATIO, test=TEST_RATIO, seed=42) -> DataFrame:
    """`split` with exact sizes: test first, then validation from the remainder.

    Rows are ranked by a hash of the key. A histogram of 65536 hash ranges tells which ranges lie
    wholly inside a split; only rows of the two ranges that hold a boundary are ranked, so there is
    no global sort and no single-task window over the data.
    """
    d = u("split", seed=seed, variant="0", plan=key)
    hashed = df.withColumn("_u", F.expr(d)).withColumn("_b", F.floor(F.col("_u") * _BUCKETS).cast("int"))
    sizes = [(r["_b"], r["n"]) for r in hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()]
    total = sum(n for _, n in sizes)
    n_test = math.ceil(total * test - 1e-9)
    n_val = math.ceil((total - n_test) * (val / (1.0 - test)) - 1e-9)
    bounds, seen = [], 0
    for b, n in sorted(sizes):
        for cut in (n_test, n_test + n_val):
            if seen < cut <= seen + n:
                bounds.append((b, seen))
        seen += n
    starts = dict(bounds)
    cut_test = next((b for b, s in sorted(starts.items()) if s < n_test), -1)
    edge = F.col("_b").isin(list(starts)) if starts else F.lit(False)
    offset = F.coalesce(*[F.when(F.col("_b") == b, F.lit(s)) for b, s in starts.items()], F.lit(0))
    ranked = hashed.filter(edge).withColumn(
        "_r", F.row_number().over(W.partitionBy("_b").orderBy("_u", key)) + offset
    ).withColumn(
        "split",
        F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").otherwise("train"),
    )
    last = max(starts, default=-1)
    clear = hashed.filter(~edge).withColumn("_r", F.lit(0)).withColumn(
        "split",
        F.when(F.col("_b") < cut_test, "test").when(F.col("_b") < last, "validation").otherwise("train"),
    )
    return ranked.unionByName(clear).drop("_u", "_b", "_r")


def violations(records: DataFrame) -> DataFrame:
    """(keys, rule, path) of every broken rule of parsed raw records; row-wise, no shuffle."""
    rids = "transform(raw.rooms, r -> r.rid)"
    known = "', '".join(DIRECTIONS)

    def rule(name, path):
        return f"named_struct('rule', '{name}', 'path', {path})"

    none = f"slice(array({rule('', chr(39) + chr(39))}), 1, 0)"
    missing = ", ".join(
        f"if(raw.{f} is null, array({rule('missing_field', chr(39) + f + chr(39))}), {none})"
        for f in ("plan_id", "rooms", "edges", "spatial")
    )

    def each(array, checks, path):
        tests = ", ".join(f"if({cond}, array({rule(name, path)}), {none})" for name, cond in checks)
        return f"coalesce(flatten(transform({array}, (q, i) -> concat({tests}))), {none})"

    rooms = each(
        "raw.rooms",
        [
            ("missing_rid", "q.rid is null"),
            ("duplicate_rid", f"q.rid is not null and array_position({rids}, q.rid) < i + 1"),
            ("missing_type", "q.rid is not null and q.type is null"),
            ("odd_coords", "q.rid is not null and size(coalesce(q.coords, array())) % 2 <> 0"),
            ("few_vertices", "q.rid is not null and size(coalesce(q.coords, array())) < 6"),
        ],
        "concat('rooms[', cast(i as string), ']')",
    )
    edges = each(
        "raw.edges",
        [
            ("pair_arity", "q.pair is null or size(q.pair) <> 2"),
            ("dangling_rid", f"size(q.pair) = 2 and not coalesce(array_contains({rids}, q.pair[0]), false)"),
            ("dangling_rid", f"size(q.pair) = 2 and not coalesce(array_contains({rids}, q.pair[1]), false)"),
        ],
        "concat('edges[', cast(i as string), ']')",
    )
    spatial = each(
        "raw.spatial",
        [
            ("spatial_arity", "size(q) <> 3"),
            ("dangling_rid", f"size(q) = 3 and not coalesce(array_contains({rids}, try_cast(q[0] as int)), false)"),
            ("dangling_rid", f"size(q) = 3 and not coalesce(array_contains({rids}, try_cast(q[1] as int)), false)"),
            ("unknown_direction", f"size(q) = 3 and q[2] not in ('{known}')"),
        ],
        "concat('spatial[', cast(i as string), ']')",
    )
    front = (
        f"if(raw.front_door is null or raw.front_door = 'null', {none}, flatten(transform(array('x', 'y', 'w', 'h'),"
        f" k -> if(get_json_object(raw.front_door, concat('$.', k)) is null,"
        f" array({rule('front_door_key', 'k')}), {none}))))"
    )
    found = (
        f"case when raw is null or raw._corrupt is not null then array({rule('not_json', chr(39) + chr(39))})"
        f" when raw.rooms is null then concat({missing})"
        f" else concat({missing}, {rooms}, {edges}, {spatial}, {front}) end"
    )
    keys = [c for c in ("file", "plan_id") if c in records.columns]
    return records.select(*keys, F.expr(found).alias("found"))


def violation_rows(records: DataFrame) -> DataFrame:
    found = violations(records)
    keys = [c for c in found.columns if c != "found"]
    return found.select(*keys, F.expr("inline_outer(found)")).filter("rule is not null")


def file_report(records: DataFrame, details: int = 20) -> DataFrame:
    """Per file: records, records with errors, pass rate, number of errors and the first details."""
    found = violations(records)
    totals = found.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.size("found") > 0).alias("n_error_records"),
        F.sum(F.size("found").cast("long")).alias("n_errors"),
    )
    # Two-step top-n: each input bucket keeps its own first rows, then the file's buckets meet.
    rows = found.select("file", "plan_id", F.expr("inline_outer(found)")).filter("rule is not null")
    key = F.concat_ws("|", F.expr("lpad(coalesce(plan_id, ''), greatest(20, length(coalesce(plan_id, ''))), '0')"), "rule", "path")
    keyed = rows.select("file", key.alias("k"), F.concat_ws(" ", "plan_id", "rule", "path").alias("d"))
    bucket = F.pmod(F.xxhash64("k"), F.lit(64))
    near = keyed.withColumn("b", bucket).withColumn(
        "r", F.row_number().over(W.partitionBy("file", "b").orderBy("k"))
    ).filter(F.col("r") <= details)
    top = near.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy("k"))).filter(F.col("r") <= details)
    first = top.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("l"))
    return totals.join(first, "file", "left").select(
        "file", "n_records", "n_error_records", "n_errors",
        F.round((F.col("n_records") - F.col("n_error_records")) / F.greatest("n_records", F.lit(1)) * 100, 1).alias("pass_rate"),
        F.expr("coalesce(array_join(transform(l, x -> x.d), '; '), '')").alias("details"),
    )


def sample_rows(df: DataFrame, k: int, key="plan_id", seed=42) -> DataFrame:
    """k rows by hash order: a top-k, so each task sends at most k rows."""
    return df.orderBy(F.expr(u("sample", seed=seed, variant="0", plan=key)), key).limit(k)


#: A sample of at most this many ids is sent to the tasks that read the source.
SENT_IDS = 100_000


def audit(converted: DataFrame, source: DataFrame, k: int | None = None, seed=42) -> DataFrame:
    """Field-wise comparison of converted plans with their parsed source records; `found` is false for a missing id.

    Every flag of a missing id is false. With k, only a sample of k converted plans is compared: up to
    SENT_IDS ids go to the tasks that read the source, which is then neither shuffled nor sorted.
    """
    picked = sample_rows(converted, k, seed=seed) if k is not None else converted
    raw = source.select(F.col("raw.plan_id").alias("plan_id"), "raw")
    if k is not None and k <= SENT_IDS:
        picked = cut_lineage(picked)
        raw = raw.join(F.broadcast(picked.select("plan_id").distinct()), "plan_id", "left_semi")
    return _compared(picked.join(raw, "plan_id", "left"))


def audit_lines(converted: DataFrame, lines: DataFrame, k: int | None = None, seed=42) -> DataFrame:
    """`audit` against JSON lines; of a sample, only the lines of its ids are parsed as records."""
    from planmill.sources.jsonl import parse_lines

    if k is None or k > SENT_IDS:
        return audit(converted, parse_lines(lines), k, seed)
    picked = cut_lineage(sample_rows(converted, k, seed=seed))
    keyed = lines.withColumn("plan_id", F.get_json_object("value", "$.plan_id"))
    own = keyed.join(F.broadcast(picked.select("plan_id").distinct()), "plan_id", "left_semi")
    raw = parse_lines(own.select("value")).select(F.col("raw.plan_id").alias("plan_id"), "raw")
    return _compared(picked.join(raw, "plan_id", "left"))


def _compared(both: DataFrame) -> DataFrame:
    return both.select(
        "plan_id",
        F.col("raw").isNotNull().alias("found"),
        F.expr("coalesce(size(rooms) = size(raw.rooms), false)").alias("same_room_count"),
        F.expr("coalesce(transform(rooms, r -> r.type) = transform(raw.rooms, r -> r.type), false)").alias("same_types"),
        F.expr("coalesce(transform(rooms, r -> r.coords) = transform(raw.rooms, r -> r.coords), false)").alias("same_coords"),
        F.expr("coalesce(transform(edges, e -> e.pair) = transform(raw.edges, e -> e.pair), false)").alias("same_pairs"),
        F.expr("raw is not null and (size(front_door) = 0) = (raw.front_door is null or raw.front_door = 'null')").alias("same_front"),
        F.expr("coalesce(size(spatial) = size(raw.spatial), false)").alias("same_spatial_count"),
    )
