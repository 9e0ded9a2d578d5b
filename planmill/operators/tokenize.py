"""Plans -> condition and answer token sequences (array<string>), one projection each."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planmill.constants import OUTLINE
from planmill.functions import geometry as g
from planmill.functions import tokens as t

_ROOMS = f"filter(rooms, r -> r.type <> '{OUTLINE}')"


def canonical_rooms(df: DataFrame) -> DataFrame:
    """`canon_rooms`: rooms without the outline, by vertex-mean y, then x."""
    keyed = (
        f"transform({_ROOMS}, (r, i) -> named_struct('cy', {g.mean(g.ys('r.coords'))},"
        f" 'cx', {g.mean(g.xs('r.coords'))}, 'i', i, 'r', r))"
    )
    return df.withColumn("canon_rooms", F.expr(f"transform(array_sort({keyed}), s -> s.r)"))


def canonical_edges(df: DataFrame) -> DataFrame:
    """`canon_edges`: edges by (smaller, larger) room number."""
    keyed = (
        "transform(edges, (e, i) -> named_struct('lo', array_min(e.pair), 'hi', array_max(e.pair), 'i', i, 'e', e))"
    )
    return df.withColumn("canon_edges", F.expr(f"transform(array_sort({keyed}), s -> s.e)"))


def type_counts(rooms=_ROOMS):
    """SQL text: array of (type, n) structs in alphabetical order."""
    types = f"transform({rooms}, r -> r.type)"
    return (
        f"transform(array_sort(array_distinct({types})),"
        f" t -> named_struct('type', t, 'n', size(filter({rooms}, r -> r.type = t))))"
    )


def summary_tokens(total_gone="total_gone", types_gone="types_gone", digits=lambda n: f"array(cast({n} as string))"):
    """Room-summary block. `digits` maps SQL text of a count to SQL text of its token array."""
    return (
        f"concat(array('<ROOM_SUMMARY>'),"
        f" if({total_gone}, {t.NO_TOKENS}, concat(array('<TOTAL>'), {digits(f'size({_ROOMS})')})),"
        f" flatten(transform(filter({type_counts()}, c -> not array_contains({types_gone}, c.type)),"
        f" c -> concat(array({t.tok('TYPE', 'c.type')}, '<COUNT>'), {digits('c.n')}))),"
        f" array('<END_ROOM_SUMMARY>'))"
    )


def condition_tokens(df: DataFrame, bos: str | None = None) -> DataFrame:
    """`condition`: the input sequence, honouring the fates added by `drop_state`."""
    lead = f"'{bos}', '<INPUT>'" if bos else "'<INPUT>'"
    rooms = t.room_tokens(
        "r", "true", "room_fate[i].no_type", "room_fate[i].no_coords", "coalesce(room_fate[i].noisy, r.coords)"
    )
    edges = t.edge_tokens("e", "edge_fate[i].pair_mode", "edge_fate[i].kept", "edge_fate[i].door_mode")
    return df.withColumn(
        "condition",
        F.expr(
            f"concat(array({lead}), {summary_tokens()},"
            f" {t.front_door_tokens('front_door', 'front_gone', 'front_bare')},"
            f" flatten(transform(rooms, (r, i) -> if(room_fate[i].gone, {t.NO_TOKENS}, {rooms}))),"
            f" flatten(transform(edges, (e, i) -> if(edge_fate[i].gone, {t.NO_TOKENS}, {edges}))),"
            f" flatten(transform(spatial, (s, i) -> if(rel_gone[i], {t.NO_TOKENS}, {t.relation_tokens('s')}))),"
            f" array('<END_INPUT>'))"
        ),
    )


def answer_tokens(df: DataFrame) -> DataFrame:
    """`answer`: front door, outline, canonical rooms without numbers, canonical doors only."""
    ordered = canonical_edges(canonical_rooms(df))
    outline = f"slice(filter(rooms, r -> r.type = '{OUTLINE}'), 1, 1)"
    return ordered.withColumn(
        "answer",
        F.expr(
            f"concat(array('<OUTPUT>'), {t.front_door_tokens('front_door')},"
            f" flatten(transform(concat({outline}, canon_rooms), r -> {t.room_tokens('r', 'false')})),"
            f" flatten(transform(canon_edges, e -> {t.door_list_tokens('e.door')})), array('<END_OUTPUT>'))"
        ),
    ).drop("canon_rooms", "canon_edges")


def answer_parts(df: DataFrame, rooms_only: bool = False, prefix: str = "_answer") -> DataFrame:
    """The answer in parts: `<prefix>_outlines` and `<prefix>_rooms`, (rid, tokens) of outlines and of rooms in order,
    and, unless `rooms_only`, `<prefix>_head` and `<prefix>_tail` before and after them."""
    made = f"named_struct('rid', r.rid, 'tokens', {t.room_tokens('r', 'false')})"
    df = canonical_rooms(df).withColumns(
        {
            f"{prefix}_outlines": F.expr(f"transform(filter(rooms, r -> r.type = '{OUTLINE}'), r -> {made})"),
            f"{prefix}_rooms": F.expr(f"transform(canon_rooms, r -> {made})"),
        }
    ).drop("canon_rooms")
    if rooms_only:
        return df
    doors = f"flatten(transform(canon_edges, e -> {t.door_list_tokens('e.door')}))"
    return canonical_edges(df).withColumns(
        {
            f"{prefix}_head": F.expr(f"concat(array('<OUTPUT>'), {t.front_door_tokens('front_door')})"),
            f"{prefix}_tail": F.expr(f"concat({doors}, array('<END_OUTPUT>'))"),
        }
    ).drop("canon_edges")


def sequence_stats(df: DataFrame, column: str, probabilities=(0.5, 0.95, 0.99)) -> DataFrame:
    """Length statistics of a token column, with exact percentiles p50_len and so on: the least length that
    reaches the share. They come from the counts of each length, which are as few as there are lengths."""
    lengths = df.groupBy(F.size(column).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    so_far = F.sum("c").over(Window.orderBy("l"))
    ranked = lengths.withColumns({"so_far": so_far, "all": F.sum("c").over(Window.partitionBy())})
    least = lambda p: F.min(F.when(F.col("so_far") >= F.ceil(F.col("all") * p), F.col("l")))
    return ranked.agg(
        F.sum("c").alias("n"),
        F.min("l").alias("min_len"),
        F.max("l").alias("max_len"),
        F.sum(F.col("l") * F.col("c")).alias("total_len"),
        F.round(F.sum(F.col("l") * F.col("c")) / F.sum("c"), 6).alias("avg_len"),
        *[least(p).alias(f"p{round(p * 100)}_len") for p in probabilities],
    )


def length_sketches(df: DataFrame, column: str, keys=(), k: int = 200) -> DataFrame:
    """(keys, sketch, n): a KLL sketch of the lengths of each group, a few hundred numbers whatever its size.

    Sketches of parts merge (`merged_sketches`), so lengths of any collection of parts are had without
    reading them again. Ranks are off by about 1.65 / k ** 0.9 of n at most, with 99 % confidence: 1.4 % for 200.
    """
    n = F.size(column).cast("bigint")
    return df.groupBy(*keys).agg(F.kll_sketch_agg_bigint(n, F.lit(k)).alias("sketch"), F.count(n).alias("n"))


def merged_sketches(sketches: DataFrame, keys=()) -> DataFrame:
    """Sketches of groups merged into those of larger groups."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, probabilities=(0.5, 0.95, 0.99)) -> DataFrame:
    """Adds the lengths p50_len and so on that a sketch estimates."""
    at = {f"p{round(p * 100)}_len": F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)) for p in probabilities}
    return sketches.withColumns(at)
