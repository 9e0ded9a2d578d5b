"""Randomised variants of plans.

Every operator is a projection over one plan row: no shuffle, and a draw that depends only on
(seed, variant, plan, operator, item). Draws are made in Arrow batches, for all steps of `augment` together.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planmill.constants import MAX_COORD, MAX_RID, OUTLINE, ROOM_TYPES
from planmill.functions import geometry as g
from planmill.functions.draws import drawn, gaussian_steps, randint, u, uniform
from planmill.functions.arrays import let
from planmill.operators.rows import keep_rows


@dataclass(frozen=True)
class AugmentConfig:
    """Switches, ranges and drop probabilities of the composed augmentation."""

    shuffle_rid: bool = True
    shuffle_vertex_order: bool = True
    shuffle_room_order: bool = True
    shuffle_edge_order: bool = True
    shuffle_spatial_order: bool = True
    reverse_spatial: bool = True
    translate: bool = True
    flip: bool = True
    scale_aspect: bool = True
    scale_min: float = 0.7
    scale_max: float = 1.4
    zoom: bool = True
    zoom_min: float = 0.7
    zoom_max: float = 1.4
    p_block: float = 0.20
    p_type: float = 0.15
    p_coords: float = 0.25
    p_edge: float = 0.20
    p_pair: float = 0.10
    p_door: float = 0.10
    p_spatial: float = 0.20
    p_front: float = 0.15
    p_front_coords: float = 0.10
    p_summary_total: float = 0.20
    p_summary_type: float = 0.30
    p_noise: float = 0.30
    sigma: float = 3.0
    seed: int = 42


CODE_DEFAULT = AugmentConfig()
SFT = replace(
    CODE_DEFAULT,
    scale_max=1.3, zoom_max=1.3,
    p_block=0.5, p_type=0.20, p_coords=0.20, p_edge=0.5, p_pair=0.20, p_door=0.20,
    p_spatial=0.8, p_front=0.50, p_front_coords=0.40,
    p_summary_total=0.50, p_summary_type=0.60, p_noise=0.50,
)
PRESETS = {"code_default": CODE_DEFAULT, "sft": SFT, "pre_stage": SFT}

_ROOMS = f"filter(rooms, r -> r.type <> '{OUTLINE}')"


_RIDS = list(range(MAX_RID + 1))
_ONE = [""]

# Items of the draws that are made in batches; a room number or type that is not among them is drawn where it is met.
_ITEMS = {
    "rid": _RIDS, "vertex": _RIDS, "room_order": _RIDS, "room_drop": _RIDS,
    "edge_order": "size(edges)", "edge_drop": "size(edges)",
    "spatial_order": "size(spatial)", "reverse": "size(spatial)", "spatial_drop": "size(spatial)",
    "translate": ["x", "y"], "scale": ["x", "y"], "flip": _ONE, "zoom": _ONE,
    "front_drop": _ONE, "summary_total": _ONE, "noise": _ONE, "summary_type": ROOM_TYPES,
}


def _with_draws(df, seed, *ops):
    """(rows with the draws of `ops` as columns `_u_<op>`, names of the columns that were not there before)."""
    made = {f"_u_{op}": drawn(op, _ITEMS[op], seed) for op in ops if f"_u_{op}" not in df.columns}
    return (df.withColumns(made) if made else df), list(made)


def _draw(op, item, seed):
    """SQL text of the draw of a number, from the batch where it is there."""
    return f"coalesce(get(_u_{op}, cast({item} as int)), {u(op, item, seed)})"


def expand_variants(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n variants per plan; the printed seed follows the sample's own number when there is one."""
    out = df.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))
    if "sample_no" in df.columns:
        out = out.withColumn(
            "aug_seed", F.expr(f"cast({seed} * 1000 + sample_no * 100 + variant as bigint)")
        )
    return out


def split_unnumberable(df: DataFrame):
    """(plans whose rooms can have numbers of their own, the others with a reason)."""
    many = f"size({_ROOMS}) > {MAX_RID}"
    return keep_rows(df, f"not {many}"), keep_rows(df, many).withColumn("reason", F.lit("too_many_rooms"))


def shuffle_rid(df: DataFrame, seed=42) -> DataFrame:
    """Renumber rooms with a random subset of 1..15, consistently in edges and relations.

    Plans with more rooms than numbers have no such subset and are left out; `split_unnumberable`
    gives them with a reason.
    """
    df, _ = split_unnumberable(df)
    df, made = _with_draws(df, seed, "rid")
    d = "_u_rid[k]"
    perm = f"transform(array_sort(transform(sequence(1, {MAX_RID}), k -> named_struct('d', {d}, 'k', k))), s -> s.k)"
    new = "coalesce(get(_perm, cast(array_position(_old, {r}) - 1 as int)), {r})"
    return (
        df.withColumn("_perm", F.expr(perm))
        .withColumn("_old", F.expr(f"transform({_ROOMS}, r -> r.rid)"))
        .withColumns(
            {
                "rooms": F.expr(
                    f"transform(rooms, r -> named_struct('rid', if(r.type = '{OUTLINE}', r.rid, {new.format(r='r.rid')}),"
                    f" 'type', r.type, 'coords', r.coords))"
                ),
                "edges": F.expr(
                    f"transform(edges, e -> named_struct('pair', transform(e.pair, p -> {new.format(r='p')}), 'door', e.door))"
                ),
                "spatial": F.expr(
                    f"transform(spatial, s -> named_struct('rid_a', {new.format(r='s.rid_a')},"
                    f" 'rid_b', {new.format(r='s.rid_b')}, 'direction', s.direction))"
                ),
            }
        )
        .drop("_perm", "_old", *made)
    )


def shuffle_vertex_order(df: DataFrame, seed=42) -> DataFrame:
    """Start every ring at a random vertex, keeping its direction."""
    df, made = _with_draws(df, seed, "vertex")
    start = f"2 * cast(floor({_draw('vertex', 'r.rid', seed)} * (size(r.coords) div 2)) as int)"
    return df.withColumn(
        "rooms",
        F.expr(
            f"transform(rooms, r -> named_struct('rid', r.rid, 'type', r.type, 'coords',"
            f" if(size(r.coords) < 4, r.coords, {let(start, 'k', g.rotate('r.coords', 'k'))})))"
        ),
    ).drop(*made)


def _by_draw(array, draw, lead="0"):
    return (
        f"transform(array_sort(transform({array}, (e, i) -> named_struct('l', {lead}, 'd', {draw}, 'i', i, 'e', e)),"
        f" (a, b) -> case when a.l <> b.l then a.l - b.l when a.d < b.d then -1 when a.d > b.d then 1"
        f" else a.i - b.i end), s -> s.e)"
    )


def shuffle_room_order(df: DataFrame, seed=42) -> DataFrame:
    """Random room order, outline first."""
    df, made = _with_draws(df, seed, "room_order")
    lead = f"if(e.type = '{OUTLINE}', 0, 1)"
    return df.withColumn("rooms", F.expr(_by_draw("rooms", _draw("room_order", "e.rid", seed), lead))).drop(*made)


def shuffle_edge_order(df: DataFrame, seed=42) -> DataFrame:
    df, made = _with_draws(df, seed, "edge_order")
    return df.withColumn("edges", F.expr(_by_draw("edges", "_u_edge_order[i]"))).drop(*made)


def shuffle_spatial_order(df: DataFrame, seed=42) -> DataFrame:
    df, made = _with_draws(df, seed, "spatial_order")
    return df.withColumn("spatial", F.expr(_by_draw("spatial", "_u_spatial_order[i]"))).drop(*made)


def reverse_spatial(df: DataFrame, seed=42) -> DataFrame:
    """Swap the ends of a relation, and turn its direction round, with p = 0.5."""
    df, made = _with_draws(df, seed, "reverse")
    return df.withColumn(
        "spatial",
        F.expr(
            f"transform(spatial, (s, i) -> if(_u_reverse[i] < 0.5D,"
            f" named_struct('rid_a', s.rid_b, 'rid_b', s.rid_a, 'direction', {g.opposite('s.direction')}), s))"
        ),
    ).drop(*made)


def _with_box(df):
    o = f"filter(rooms, r -> r.type = '{OUTLINE}')[0].coords"
    return df.withColumn("_ox", F.expr(g.xs(o))).withColumn("_oy", F.expr(g.ys(o))).withColumn(
        "_box",
        F.expr(
            "named_struct('x1', array_min(_ox), 'y1', array_min(_oy), 'x2', array_max(_ox), 'y2', array_max(_oy))"
        ),
    ).drop("_ox", "_oy")


def affine(df: DataFrame, tx, ty, sw="1D", sh="1D") -> DataFrame:
    """Shared kernel: vertices rounded, door centres clamped to the grid, door sizes scaled only.

    `tx` / `ty` map SQL text of a coordinate to SQL text of the moved one.
    """
    def door(d):
        return (
            f"named_struct('x', greatest(0D, least({tx(d + '.x')}, {MAX_COORD}D)),"
            f" 'y', greatest(0D, least({ty(d + '.y')}, {MAX_COORD}D)),"
            f" 'w', {d}.w * {sw}, 'h', {d}.h * {sh})"
        )

    return df.withColumns(
        {
            "rooms": F.expr(
                f"transform(rooms, r -> named_struct('rid', r.rid, 'type', r.type, 'coords',"
                f" transform(r.coords, (v, i) -> cast(rint(if(i % 2 = 0, {tx('cast(v as double)')},"
                f" {ty('cast(v as double)')})) as int))))"
            ),
            "front_door": F.expr(f"transform(front_door, d -> {door('d')})"),
            "edges": F.expr(
                f"transform(edges, e -> named_struct('pair', e.pair, 'door', transform(e.door, d -> {door('d')})))"
            ),
        }
    )


def translate(df: DataFrame, seed=42) -> DataFrame:
    """Move by a random whole offset that keeps the outline box on the grid."""
    df, made = _with_draws(df, seed, "translate")
    moved = _with_box(df).withColumns(
        {
            "_dx": F.expr(randint("-_box.x1", f"{MAX_COORD} - _box.x2", "_u_translate[0]").replace("- -", "+ ")),
            "_dy": F.expr(randint("-_box.y1", f"{MAX_COORD} - _box.y2", "_u_translate[1]").replace("- -", "+ ")),
        }
    )
    return affine(moved, lambda v: f"({v} + _dx)", lambda v: f"({v} + _dy)").drop("_box", "_dx", "_dy", *made)


def flip(df: DataFrame, seed=42) -> DataFrame:
    """Mirror in x, in y or in both (equally likely); directions follow."""
    df, made = _with_draws(df, seed, "flip")
    marked = df.withColumn("_mode", F.expr("cast(floor(_u_flip[0] * 3) as int)"))
    moved = affine(
        marked,
        lambda v: f"if(_mode <> 1, {MAX_COORD}D - {v}, {v})",
        lambda v: f"if(_mode <> 0, {MAX_COORD}D - {v}, {v})",
    )
    turned = f"if(_mode <> 1, {g.mirror_h('s.direction')}, s.direction)"
    return moved.withColumn(
        "spatial",
        F.expr(
            f"transform(spatial, s -> named_struct('rid_a', s.rid_a, 'rid_b', s.rid_b, 'direction',"
            f" if(_mode <> 0, {g.mirror_v(turned)}, {turned})))"
        ),
    ).drop("_mode", *made)


def scale_aspect(df: DataFrame, lo=0.7, hi=1.4, seed=42) -> DataFrame:
    """Independent x / y scale about the box's top left, limited so that the box still fits."""
    def fit(a, b):
        return f"if({b} > {a}, ({MAX_COORD}D - {a}) / ({b} - {a}), 1D)"

    df, made = _with_draws(df, seed, "scale")
    scaled = _with_box(df).withColumns(
        {
            "_sx": F.expr(uniform(f"{lo}D", f"least({hi}D, {fit('_box.x1', '_box.x2')})", "_u_scale[0]")),
            "_sy": F.expr(uniform(f"{lo}D", f"least({hi}D, {fit('_box.y1', '_box.y2')})", "_u_scale[1]")),
        }
    )
    return affine(
        scaled,
        lambda v: f"(_box.x1 + ({v} - _box.x1) * _sx)",
        lambda v: f"(_box.y1 + ({v} - _box.y1) * _sy)",
        "_sx",
        "_sy",
    ).drop("_box", "_sx", "_sy", *made)


def zoom(df: DataFrame, lo=0.7, hi=1.4, seed=42) -> DataFrame:
    """Uniform scale about the box centre, moved back inside where it leaves the grid."""
    w, h = "(_box.x2 - _box.x1)", "(_box.y2 - _box.y1)"
    fit = f"if({w} > 0 and {h} > 0, least({MAX_COORD}D / {w}, {MAX_COORD}D / {h}), 1D)"

    def back(c, a, b):
        return (
            f"if({c} + ({a} - {c}) * _s < 0, greatest(0D, -({c} + ({a} - {c}) * _s)),"
            f" least(0D, {MAX_COORD}D - ({c} + ({b} - {c}) * _s)))"
        )

    df, made = _with_draws(df, seed, "zoom")
    scaled = (
        _with_box(df)
        .withColumns(
            {
                "_s": F.expr(uniform(f"{lo}D", f"least({hi}D, {fit})", "_u_zoom[0]")),
                "_cx": F.expr("(_box.x1 + _box.x2) / 2D"),
                "_cy": F.expr("(_box.y1 + _box.y2) / 2D"),
            }
        )
        .withColumns(
            {"_mx": F.expr(back("_cx", "_box.x1", "_box.x2")), "_my": F.expr(back("_cy", "_box.y1", "_box.y2"))}
        )
    )
    return affine(
        scaled,
        lambda v: f"(_cx + ({v} - _cx) * _s + _mx)",
        lambda v: f"(_cy + ({v} - _cy) * _s + _my)",
        "_s",
        "_s",
    ).drop("_box", "_s", "_cx", "_cy", "_mx", "_my", *made)


def drop_state(df: DataFrame, cfg: AugmentConfig = CODE_DEFAULT) -> DataFrame:
    """Decide what the condition leaves out; the plan itself stays as it is.

    Adds fates aligned with `rooms`, `edges` and `spatial`, and flags for the front door and
    the room summary. Edges and relations of a dropped room go with it.
    """
    p, seed = cfg, cfg.seed
    df, made = _with_draws(df, seed, "room_drop", "edge_drop", "spatial_drop", "front_drop", "summary_total", "summary_type")
    rolled = df.withColumn(
        "_roll", F.expr(f"transform(rooms, r -> {_draw('room_drop', 'r.rid', seed)})")
    ).withColumn(
        "_gone_rids",
        F.expr(
            f"transform(filter(zip_with(rooms, _roll, (r, d) -> named_struct('r', r, 'd', d)),"
            f" z -> z.d < {p.p_block}D and z.r.type <> '{OUTLINE}'), z -> z.r.rid)"
        ),
    )
    bt, btc = p.p_block + p.p_type, p.p_block + p.p_type + p.p_coords
    room_fate = (
        f"zip_with(rooms, _roll, (r, d) -> named_struct('gone', d < {p.p_block}D,"
        f" 'no_type', d >= {p.p_block}D and d < {bt!r}D and r.type <> '{OUTLINE}',"
        f" 'no_coords', d >= {p.p_block}D and not (d < {bt!r}D and r.type <> '{OUTLINE}') and d < {btc!r}D,"
        f" 'noisy', cast(null as array<int>)))"
    )
    d = "_u_edge_drop[i]"
    ep, epd = p.p_edge + p.p_pair, p.p_edge + p.p_pair + p.p_door
    rolled = rolled.withColumn(
        "_edge_roll",
        F.expr(
            f"transform(edges, (e, i) -> if(exists(e.pair, r -> array_contains(_gone_rids, r)), -1D, {d}))"
        ),
    )
    one = f"{u('pair_mode', 'i', seed)} < 0.5D"
    keep = f"e.pair[cast(floor({u('pair_keep', 'i', seed)} * size(e.pair)) as int)]"
    mode = f"array('position', 'orientation', 'all')[cast(floor({u('door_mode', 'i', seed)} * 3) as int)]"
    in_pair = f"_edge_roll[i] >= {p.p_edge}D and _edge_roll[i] < {ep!r}D"
    in_door = f"_edge_roll[i] >= {ep!r}D and _edge_roll[i] < {epd!r}D and size(e.door) > 0"
    edge_fate = (
        f"transform(edges, (e, i) -> named_struct('gone', _edge_roll[i] < {p.p_edge}D,"
        f" 'pair_mode', case when not ({in_pair}) then cast(null as string) when {one} then 'one' else 'both' end,"
        f" 'kept', case when {in_pair} and {one} then {keep} end,"
        f" 'door_mode', case when {in_door} then {mode} end))"
    )
    rel_gone = (
        f"transform(spatial, (s, i) -> array_contains(_gone_rids, s.rid_a) or array_contains(_gone_rids, s.rid_b)"
        f" or _u_spatial_drop[i] < {p.p_spatial}D)"
    )
    front = "_u_front_drop[0]"
    fc = p.p_front + p.p_front_coords
    types = f"array_sort(array_distinct(transform({_ROOMS}, r -> r.type)))"
    listed = "array(" + ", ".join(f"'{t}'" for t in ROOM_TYPES) + ")"
    of_type = f"coalesce(get(_u_summary_type, cast(array_position({listed}, t) - 1 as int)), {u('summary_type', 't', seed)})"
    return rolled.withColumns(
        {
            "room_fate": F.expr(room_fate),
            "edge_fate": F.expr(edge_fate),
            "rel_gone": F.expr(rel_gone),
            "front_gone": F.expr(f"{front} < {p.p_front}D"),
            "front_bare": F.expr(f"{front} >= {p.p_front}D and {front} < {fc!r}D"),
            "total_gone": F.expr(f"_u_summary_total[0] < {p.p_summary_total}D"),
            "types_gone": F.expr(f"filter({types}, t -> {of_type} < {p.p_summary_type}D)"),
        }
    ).drop("_roll", "_gone_rids", "_edge_roll", *made)


def keep_everything(df: DataFrame) -> DataFrame:
    """The fates of a plan that is shown in full."""
    return df.withColumns(
        {
            "room_fate": F.expr(
                "transform(rooms, r -> named_struct('gone', false, 'no_type', false, 'no_coords', false,"
                " 'noisy', cast(null as array<int>)))"
            ),
            "edge_fate": F.expr(
                "transform(edges, e -> named_struct('gone', false, 'pair_mode', cast(null as string),"
                " 'kept', cast(null as int), 'door_mode', cast(null as string)))"
            ),
            "rel_gone": F.expr("transform(spatial, s -> false)"),
            "front_gone": F.lit(False),
            "front_bare": F.lit(False),
            "total_gone": F.lit(False),
            "types_gone": F.expr("cast(array() as array<string>)"),
        }
    )


def coord_noise(df: DataFrame, cfg: AugmentConfig = CODE_DEFAULT) -> DataFrame:
    """Gaussian noise for the condition's vertices, with p per plan; needs `room_fate`."""
    df, made = _with_draws(df, cfg.seed, "noise")
    steps = gaussian_steps(
        "transform(rooms, r -> cast(r.rid as string))", "transform(rooms, r -> size(r.coords))", f"_u_noise[0] < {cfg.p_noise}D", cfg.sigma, cfg.seed
    )
    noisy = f"transform(rooms[k].coords, (v, i) -> cast(greatest(0, least({MAX_COORD}, v + _steps[k][i])) as int))"
    return df.withColumn("_steps", steps).withColumn(
        "room_fate",
        F.expr(
            f"transform(room_fate, (f, k) -> named_struct('gone', f.gone, 'no_type', f.no_type,"
            f" 'no_coords', f.no_coords, 'noisy', if(_steps is null, cast(null as array<int>), {noisy})))"
        ),
    ).drop("_steps", *made)


def transform_steps(cfg: AugmentConfig = CODE_DEFAULT):
    """(name, function) of the switched-on plan transforms in their fixed order."""
    s = cfg.seed
    steps = [
        (cfg.shuffle_rid, "ShuffleRID", lambda d: shuffle_rid(d, s)),
        (cfg.shuffle_vertex_order, "ShuffleVertexOrder", lambda d: shuffle_vertex_order(d, s)),
        (cfg.shuffle_room_order, "ShuffleRoomOrder", lambda d: shuffle_room_order(d, s)),
        (cfg.shuffle_edge_order, "ShuffleEdgeOrder", lambda d: shuffle_edge_order(d, s)),
        (cfg.shuffle_spatial_order, "ShuffleSpatialOrder", lambda d: shuffle_spatial_order(d, s)),
        (cfg.reverse_spatial, "ReverseSpatialRelation", lambda d: reverse_spatial(d, s)),
        (cfg.translate, "Translate", lambda d: translate(d, s)),
        (cfg.flip, "Flip", lambda d: flip(d, s)),
        (cfg.scale_aspect, "ScaleAspect", lambda d: scale_aspect(d, cfg.scale_min, cfg.scale_max, s)),
        (cfg.zoom, "Zoom", lambda d: zoom(d, cfg.zoom_min, cfg.zoom_max, s)),
    ]
    return [(name, step) for on, name, step in steps if on]


def augment(df: DataFrame, cfg: AugmentConfig = CODE_DEFAULT) -> DataFrame:
    """Shuffles, geometry, drops and noise in their fixed order; one projection chain, no shuffle."""
    df, made = _with_draws(df, cfg.seed, *_ITEMS)
    for _, step in transform_steps(cfg):
        df = df.transform(step)
    return df.transform(lambda d: drop_state(d, cfg)).transform(lambda d: coord_noise(d, cfg)).drop(*made)


def augment_with_rejected(df: DataFrame, cfg: AugmentConfig = CODE_DEFAULT):
    """(augmented plans, input rows that `augment` leaves out, with a reason)."""
    _, rejected = split_unnumberable(df)
    return augment(df, cfg), rejected if cfg.shuffle_rid else rejected.limit(0)


def augment_summary(df: DataFrame, cfg: AugmentConfig = CODE_DEFAULT, none_text="없음") -> DataFrame:
    """Readable list of what was applied to each row. The words and the "none" text are fixed values."""
    def listed(name, values, label="rids"):
        return (
            f"if(size({values}) = 0, cast(null as string),"
            f" concat('{name}({label}=[', array_join(transform({values}, v -> cast(v as string)), ', '), '])'))"
        )

    def rids(flag):
        return (
            f"array_sort(transform(filter(zip_with(rooms, room_fate, (r, f) -> named_struct('r', r, 'f', f)),"
            f" z -> {flag}), z -> z.r.rid))"
        )

    def entries(name, field, text):
        kept = f"filter(transform(edge_fate, (f, i) -> if(not f.gone and f.{field} is not null, concat(cast(i as string), ': ', {text}), cast(null as string))), t -> t is not null)"
        return f"if(size({kept}) = 0, cast(null as string), concat('{name}({{', array_join({kept}, ', '), '}})'))"

    steps = [name for name, _ in transform_steps(cfg)]
    parts = [f"'{s}'" for s in steps] + [
        listed("CoordNoise", rids("z.f.noisy is not null")),
        listed("DropBlock", rids("z.f.gone")),
        listed("DropType", rids("z.f.no_type")),
        listed("DropCoords", rids("z.f.no_coords")),
        listed("DropEdge", "filter(transform(edge_fate, (f, i) -> if(f.gone, i, cast(null as int))), v -> v is not null)", "idxs"),
        entries("DropEdgePair", "pair_mode", "if(f.pair_mode = 'both', '\\'both\\'', concat('(\\'one\\', ', cast(f.kept as string), ')'))"),
        entries("DropEdgeDoor", "door_mode", "concat('\\'', f.door_mode, '\\'')"),
        listed("DropSpatial", "filter(transform(rel_gone, (f, i) -> if(f, i, cast(null as int))), v -> v is not null)", "idxs"),
        "if(front_gone, 'DropFrontDoor', cast(null as string))",
        "if(front_bare, 'DropFrontDoorCoords', cast(null as string))",
        "if(total_gone, 'DropRoomSummaryTotal', cast(null as string))",
        "if(size(types_gone) = 0, cast(null as string), concat('DropRoomSummaryType(types=[',"
        " array_join(transform(types_gone, t -> concat('\\'', t, '\\'')), ', '), '])'))",
    ]
    return df.withColumn(
        "summary", F.expr(f"coalesce(nullif(concat_ws(', ', {', '.join(parts)}), ''), '{none_text}')")
    )
