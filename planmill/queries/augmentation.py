"""Augmentation queries: one per operator, plus the composed augmentation."""

from pyspark.sql import functions as F

from planmill.constants import MAX_COORD, MAX_RID, OUTLINE
from planmill.operators import augment as a
from planmill.operators import normalize as n
from planmill.operators import tokenize as tk
from planmill.queries import sql as s
from planmill.queries.registry import query
from planmill.sources import tables


def plans(spark, sf):
    return n.row_view(tables.plans(spark, sf))


def one(spark, sf):
    return plans(spark, sf).withColumn("variant", F.lit(1))


# --- flat dumps -------------------------------------------------------------------------

_M = "cast(cast(rint({} * 1000) as bigint) as string)"


def dump(df, rooms=True, edges=True, front=False, spatial=True):
    """Long rows (plan_id, variant, kind, pos, val) of the chosen parts."""
    parts = []
    if rooms:
        parts.append(
            "transform(rooms, (r, i) -> named_struct('kind', 'room', 'pos', i, 'val',"
            " concat(cast(r.rid as string), ':', r.type, ':', array_join(transform(r.coords, v -> cast(v as string)), ','))))"
        )
    door = "concat_ws(',', " + ", ".join(_M.format(f"d.{k}") for k in "xywh") + ")"
    if edges:
        parts.append(
            f"transform(edges, (e, i) -> named_struct('kind', 'edge', 'pos', i, 'val',"
            f" concat(cast(e.pair[0] as string), '-', cast(e.pair[1] as string), ':', array_join(transform(e.door, d -> {door}), ';'))))"
        )
    if front:
        parts.append(
            f"transform(front_door, (d, i) -> named_struct('kind', 'front', 'pos', i, 'val', {door}))"
        )
    if spatial:
        parts.append(
            "transform(spatial, (s, i) -> named_struct('kind', 'rel', 'pos', i, 'val',"
            " concat(cast(s.rid_a as string), '-', cast(s.rid_b as string), ':', s.direction)))"
        )
    return df.select("plan_id", "variant", F.expr(f"inline_outer(concat({', '.join(parts)}))")).filter("kind is not null")


_DM = "round_even({} * 1000, 0)::BIGINT::VARCHAR"


def dump_sql(suffix, rooms=True, edges=True, front=False, spatial=True):
    parts = []
    door = "concat_ws(',', " + ", ".join(_DM.format(k) for k in "xywh") + ")"
    if rooms:
        parts.append(
            "SELECT plan_id, variant, 'room' AS kind, pos::INTEGER AS pos, rid::VARCHAR || ':' || type || ':' ||"
            f" array_to_string(coords, ',') AS val FROM room{suffix}"
        )
    if edges:
        parts.append(
            "SELECT plan_id, variant, 'edge' AS kind, pos::INTEGER AS pos, a::VARCHAR || '-' || b::VARCHAR || ':' ||"
            f" CASE WHEN hd THEN {door} ELSE '' END AS val FROM edge{suffix}"
        )
    if front:
        parts.append(f"SELECT plan_id, variant, 'front' AS kind, 0 AS pos, {door} AS val FROM front{suffix}")
    if spatial:
        parts.append(
            "SELECT plan_id, variant, 'rel' AS kind, pos::INTEGER AS pos,"
            f" a::VARCHAR || '-' || b::VARCHAR || ':' || direction AS val FROM rel{suffix}"
        )
    return "\nUNION ALL\n".join(parts)


def digests(rows):
    """(plan_id, kind, n, digest) of long text rows: a sum of hashes of place and text, so that no plan is gathered."""
    part = F.conv(F.substring(F.md5(F.concat(F.col("pos").cast("string"), F.lit("|"), "val")), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def digest_sql(rows):
    return f"""SELECT plan_id, kind, count(*) AS n, sum(('0x' || substr(md5(pos::VARCHAR || '|' || val), 1, 8))::BIGINT)::BIGINT AS digest
        FROM ({rows}) GROUP BY ALL"""


# --- the same steps on flat tables --------------------------------------------------------

def sql_shuffle_rid(i, o):
    return {
        f"perm{o}": f"""SELECT plan_id, variant, k, row_number() OVER (PARTITION BY plan_id, variant ORDER BY {s.u('rid', 'k')}, k) AS slot
            FROM (SELECT plan_id, variant, unnest(range(1, {MAX_RID + 1}))::INTEGER AS k FROM (SELECT DISTINCT plan_id, variant FROM room{i}))""",
        f"renum{o}": f"""SELECT r.plan_id, r.variant, r.rid AS old_rid, p.k AS new_rid
            FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, variant ORDER BY pos) AS slot FROM room{i} WHERE type <> '{OUTLINE}') r
            JOIN perm{o} p USING (plan_id, variant, slot)""",
        f"room{o}": f"""SELECT plan_id, variant, pos, coalesce(new_rid, rid) AS rid, type, coords
            FROM room{i} LEFT JOIN renum{o} USING (plan_id, variant) WHERE rid = old_rid AND type <> '{OUTLINE}'
            UNION ALL SELECT plan_id, variant, pos, rid, type, coords FROM room{i} WHERE type = '{OUTLINE}'""",
        f"edge{o}": f"""SELECT e.* REPLACE (coalesce(p.new_rid, e.a) AS a, coalesce(q.new_rid, e.b) AS b) FROM edge{i} e
            LEFT JOIN renum{o} p ON p.plan_id = e.plan_id AND p.variant = e.variant AND p.old_rid = e.a
            LEFT JOIN renum{o} q ON q.plan_id = e.plan_id AND q.variant = e.variant AND q.old_rid = e.b""",
        f"rel{o}": f"""SELECT e.* REPLACE (coalesce(p.new_rid, e.a) AS a, coalesce(q.new_rid, e.b) AS b) FROM rel{i} e
            LEFT JOIN renum{o} p ON p.plan_id = e.plan_id AND p.variant = e.variant AND p.old_rid = e.a
            LEFT JOIN renum{o} q ON q.plan_id = e.plan_id AND q.variant = e.variant AND q.old_rid = e.b""",
        f"front{o}": f"SELECT * FROM front{i}",
    }


def _same(i, o, *changed):
    return {f"{t}{o}": f"SELECT * FROM {t}{i}" for t in ("room", "edge", "front", "rel") if t not in changed}


def sql_vertex_order(i, o):
    start = f"(2 * floor({s.u('vertex', 'rid')} * (len(coords) // 2)))::BIGINT"
    return {
        f"room{o}": f"""SELECT * REPLACE (CASE WHEN len(coords) < 4 THEN coords
            ELSE coords[{start} + 1:] || coords[1:{start}] END AS coords) FROM room{i}""",
        **_same(i, o, "room"),
    }


def sql_room_order(i, o):
    return {
        f"room{o}": f"""SELECT * REPLACE ((row_number() OVER (PARTITION BY plan_id, variant
            ORDER BY (type <> '{OUTLINE}')::INTEGER, {s.u('room_order', 'rid')}, pos) - 1) AS pos) FROM room{i}""",
        **_same(i, o, "room"),
    }


def _sql_order(table, op):
    def step(i, o):
        return {
            f"{table}{o}": f"""SELECT * REPLACE ((row_number() OVER (PARTITION BY plan_id, variant
                ORDER BY {s.u(op, 'pos')}, pos) - 1)::INTEGER AS pos) FROM {table}{i}""",
            **_same(i, o, table),
        }

    return step


sql_edge_order = _sql_order("edge", "edge_order")
sql_spatial_order = _sql_order("rel", "spatial_order")


def sql_reverse(i, o):
    back = s.swap(s.swap("direction", "left", "right"), "above", "below")
    return {
        f"rel{o}": f"""SELECT plan_id, variant, pos, CASE WHEN r THEN b ELSE a END AS a, CASE WHEN r THEN a ELSE b END AS b,
            CASE WHEN r THEN {back} ELSE direction END AS direction
            FROM (SELECT *, {s.u('reverse', 'pos')} < 0.5 AS r FROM rel{i})""",
        **_same(i, o, "rel"),
    }


def _sql_affine(i, o, move, tx, ty, sw="1", sh="1"):
    """`move`: SELECT of (plan_id, variant, parameters); tx / ty map coordinate text."""
    hi = MAX_COORD
    return {
        f"bb{o}": f"""SELECT plan_id, variant, list_min({s.xs('coords')}) AS bx1, list_min({s.ys('coords')}) AS by1,
            list_max({s.xs('coords')}) AS bx2, list_max({s.ys('coords')}) AS by2 FROM room{i} WHERE type = '{OUTLINE}'""",
        f"mv{o}": move.replace("@box", f"bb{o}"),
        f"room{o}": f"""SELECT plan_id, variant, pos, rid, type, list_transform(coords, lambda v, i: CASE WHEN i % 2 = 1
            THEN {s.ri(tx('v::DOUBLE'))} ELSE {s.ri(ty('v::DOUBLE'))} END) AS coords FROM room{i} JOIN mv{o} USING (plan_id, variant)""",
        f"edge{o}": f"""SELECT plan_id, variant, pos, a, b, hd, greatest(0, least({tx('x')}, {hi})) AS x, greatest(0, least({ty('y')}, {hi})) AS y,
            w * {sw} AS w, h * {sh} AS h FROM edge{i} JOIN mv{o} USING (plan_id, variant)""",
        f"front{o}": f"""SELECT plan_id, variant, greatest(0, least({tx('x')}, {hi})) AS x, greatest(0, least({ty('y')}, {hi})) AS y,
            w * {sw} AS w, h * {sh} AS h FROM front{i} JOIN mv{o} USING (plan_id, variant)""",
    }


def sql_translate(i, o):
    dx = f"-bx1 + floor({s.u('translate', chr(39) + 'x' + chr(39))} * ({MAX_COORD} - bx2 + bx1 + 1))"
    dy = f"-by1 + floor({s.u('translate', chr(39) + 'y' + chr(39))} * ({MAX_COORD} - by2 + by1 + 1))"
    return {
        **_sql_affine(
            i, o, f"SELECT plan_id, variant, {dx} AS dx, {dy} AS dy FROM @box",
            lambda v: f"({v} + dx)", lambda v: f"({v} + dy)",
        ),
        f"rel{o}": f"SELECT * FROM rel{i}",
    }


def sql_flip(i, o):
    hi = MAX_COORD
    turned = f"(CASE WHEN m <> 1 THEN {s.swap('direction', 'left', 'right')} ELSE direction END)"
    return {
        **_sql_affine(
            i, o, f"SELECT plan_id, variant, floor({s.u('flip')} * 3)::INTEGER AS m FROM @box",
            lambda v: f"(CASE WHEN m <> 1 THEN {hi} - {v} ELSE {v} END)",
            lambda v: f"(CASE WHEN m <> 0 THEN {hi} - {v} ELSE {v} END)",
        ),
        f"rel{o}": f"""SELECT plan_id, variant, pos, a, b, CASE WHEN m <> 0 THEN {s.swap(turned, 'above', 'below')} ELSE {turned} END AS direction
            FROM rel{i} JOIN mv{o} USING (plan_id, variant)""",
    }


def sql_scale(lo, hi):
    def fit(a, b):
        return f"CASE WHEN {b} > {a} THEN ({MAX_COORD}::DOUBLE - {a}) / ({b} - {a})::DOUBLE ELSE 1::DOUBLE END"

    def step(i, o):
        def sc(a, b, k):
            return f"{lo}::DOUBLE + (least({hi}::DOUBLE, {fit(a, b)}) - {lo}::DOUBLE) * {s.u('scale', chr(39) + k + chr(39))}"

        return {
            **_sql_affine(
                i, o,
                f"SELECT plan_id, variant, bx1, by1, {sc('bx1', 'bx2', 'x')} AS sx, {sc('by1', 'by2', 'y')} AS sy FROM @box",
                lambda v: f"(bx1 + ({v} - bx1) * sx)", lambda v: f"(by1 + ({v} - by1) * sy)", "sx", "sy",
            ),
            f"rel{o}": f"SELECT * FROM rel{i}",
        }

    return step


def sql_zoom(lo, hi):
    m = f"{MAX_COORD}::DOUBLE"

    def step(i, o):
        def back(c, a, b):
            return (
                f"CASE WHEN {c} + ({a} - {c}) * z < 0 THEN greatest(0, -({c} + ({a} - {c}) * z))"
                f" ELSE least(0, {m} - ({c} + ({b} - {c}) * z)) END"
            )

        fit = f"CASE WHEN bx2 > bx1 AND by2 > by1 THEN least({m} / (bx2 - bx1)::DOUBLE, {m} / (by2 - by1)::DOUBLE) ELSE 1::DOUBLE END"
        inner = (
            f"SELECT *, {lo}::DOUBLE + (least({hi}::DOUBLE, {fit}) - {lo}::DOUBLE) * {s.u('zoom')} AS z,"
            f" (bx1 + bx2)::DOUBLE / 2 AS cx, (by1 + by2)::DOUBLE / 2 AS cy FROM @box"
        )
        return {
            **_sql_affine(
                i, o,
                f"SELECT plan_id, variant, z, cx, cy, {back('cx', 'bx1', 'bx2')} AS mx, {back('cy', 'by1', 'by2')} AS my FROM ({inner})",
                lambda v: f"(cx + ({v} - cx) * z + mx)", lambda v: f"(cy + ({v} - cy) * z + my)", "z", "z",
            ),
            f"rel{o}": f"SELECT * FROM rel{i}",
        }

    return step


def chained(steps):
    """CTEs of several steps, from suffix 0 to suffix len(steps)."""
    out = {}
    for k, step in enumerate(steps):
        out.update(step(str(k), str(k + 1)))
    return out


def _register(name, spark_step, sql_step, **parts):
    sql = s.with_ctes(dump_sql("1", **parts), chained([sql_step]))
    query(name, sql)(lambda spark, sf: dump(one(spark, sf).transform(spark_step), **parts))


_register("shuffle_rid", a.shuffle_rid, sql_shuffle_rid)
_register("shuffle_vertex_order", a.shuffle_vertex_order, sql_vertex_order, edges=False, spatial=False)
_register("shuffle_room_order", a.shuffle_room_order, sql_room_order, edges=False, spatial=False)
_register("shuffle_edge_order", a.shuffle_edge_order, sql_edge_order, rooms=False, spatial=False)
_register("shuffle_spatial_order", a.shuffle_spatial_order, sql_spatial_order, rooms=False, edges=False)
_register("reverse_spatial_relation", a.reverse_spatial, sql_reverse, rooms=False, edges=False)
_register("translate", a.translate, sql_translate, front=True, spatial=False)
_register("flip", a.flip, sql_flip, front=True)
_register("scale_aspect", a.scale_aspect, sql_scale(0.7, 1.4), front=True, spatial=False)
_register("zoom", a.zoom, sql_zoom(0.7, 1.4), front=True, spatial=False)
_register(
    "affine_transform",
    lambda d: a.affine(d, lambda v: f"({v} * 1.25D - 10D)", lambda v: f"({v} * 0.5D + 20D)", "1.25D", "0.5D"),
    lambda i, o: _sql_affine(
        i, o, "SELECT plan_id, variant FROM @box",
        lambda v: f"({v} * 1.25::DOUBLE - 10)", lambda v: f"({v} * 0.5::DOUBLE + 20)", "1.25::DOUBLE", "0.5::DOUBLE",
    ),
    front=True, spatial=False,
)

TRANSFORM_SQL = [
    sql_shuffle_rid, sql_vertex_order, sql_room_order, sql_edge_order, sql_spatial_order, sql_reverse,
    sql_translate, sql_flip, sql_scale(0.7, 1.3), sql_zoom(0.7, 1.3),
]
CHAIN = chained(TRANSFORM_SQL)


@query("expand_variants", s.with_ctes(
    """SELECT plan_id, v::INTEGER AS variant, (42 * 1000 + sample_no * 100 + v)::BIGINT AS aug_seed, n AS n_rooms
       FROM (SELECT plan_id, n, ok AS sample_no, unnest([1, 2, 3]) AS v FROM outl)"""))
def expand_variants(spark, sf):
    numbered = plans(spark, sf).withColumn("sample_no", F.col("plan_id").cast("long"))
    return a.expand_variants(numbered, 3).select(
        "plan_id", "variant", "aug_seed", (F.size("rooms") - 1).alias("n_rooms")
    )


# --- noise and drops -----------------------------------------------------------------------

def noise_sql(suffix, p, sigma):
    z = (
        f"sqrt(-2::DOUBLE * ln(1 - {s.u('noise_r', 'rid::VARCHAR || chr(58) || (i - 1)::VARCHAR')}))"
        f" * cos(2::DOUBLE * pi() * {s.u('noise_a', 'rid::VARCHAR || chr(58) || (i - 1)::VARCHAR')})"
    )
    return f"""SELECT plan_id, variant, rid, list_transform(coords, lambda v, i:
        greatest(0, least({MAX_COORD}, v + {s.ri(z + f' * {sigma}')}))::INTEGER) AS noisy
        FROM room{suffix} WHERE {s.u('noise')} < {p}"""


@query("coord_noise", s.with_ctes(
    "SELECT plan_id, variant, rid, array_to_string(noisy, ',') AS noisy FROM nz", {"nz": noise_sql("0", 0.30, 3.0)}))
def coord_noise(spark, sf):
    df = a.coord_noise(a.keep_everything(one(spark, sf)))
    return df.select(
        "plan_id", "variant",
        F.expr("inline_outer(zip_with(rooms, room_fate, (r, f) -> named_struct('rid', r.rid, 'noisy', f.noisy)))"),
    ).filter("noisy is not null").withColumn("noisy", F.expr("array_join(transform(noisy, v -> cast(v as string)), ',')"))


def fates_sql(suffix, c):
    """Drop decisions on flat tables."""
    bt, btc = c.p_block + c.p_type, c.p_block + c.p_type + c.p_coords
    ep, epd = c.p_edge + c.p_pair, c.p_edge + c.p_pair + c.p_door
    return {
        "rfate": f"""SELECT plan_id, variant, pos, rid, type, d < {c.p_block!r} AS gone,
              d >= {c.p_block!r} AND d < {bt!r} AND type <> '{OUTLINE}' AS no_type,
              d >= {c.p_block!r} AND NOT (d < {bt!r} AND type <> '{OUTLINE}') AND d < {btc!r} AS no_coords
            FROM (SELECT *, {s.u('room_drop', 'rid')} AS d FROM room{suffix})""",
        "hit": f"SELECT plan_id, variant, rid FROM rfate WHERE gone AND type <> '{OUTLINE}'",
        "eroll": f"""SELECT e.*, {s.u('edge_drop', 'pos')} AS d, EXISTS (SELECT 1 FROM hit h WHERE h.plan_id = e.plan_id
              AND h.variant = e.variant AND h.rid IN (e.a, e.b)) AS orphan FROM edge{suffix} e""",
        "efate": f"""SELECT plan_id, variant, pos, a, b, orphan, orphan OR d < {c.p_edge!r} AS gone,
              CASE WHEN NOT orphan AND d >= {c.p_edge!r} AND d < {ep!r} THEN
                CASE WHEN {s.u('pair_mode', 'pos')} < 0.5 THEN 'one' ELSE 'both' END END AS pair_mode,
              CASE WHEN NOT orphan AND d >= {c.p_edge!r} AND d < {ep!r} AND {s.u('pair_mode', 'pos')} < 0.5 THEN
                CASE WHEN {s.u('pair_keep', 'pos')} < 0.5 THEN a ELSE b END END AS kept,
              CASE WHEN NOT orphan AND d >= {ep!r} AND d < {epd!r} AND hd THEN
                ['position', 'orientation', 'all'][floor({s.u('door_mode', 'pos')} * 3)::INTEGER + 1] END AS door_mode
            FROM eroll""",
        "sfate": f"""SELECT r.plan_id, r.variant, r.pos, r.a, r.b, EXISTS (SELECT 1 FROM hit h WHERE h.plan_id = r.plan_id
              AND h.variant = r.variant AND h.rid IN (r.a, r.b)) AS orphan, {s.u('spatial_drop', 'pos')} < {c.p_spatial!r} AS rolled FROM rel{suffix} r""",
        "pfate": f"""SELECT plan_id, variant, d < {c.p_front!r} AS front_gone, d >= {c.p_front!r} AND d < {c.p_front + c.p_front_coords!r} AS front_bare,
              {s.u('summary_total')} < {c.p_summary_total!r} AS total_gone
            FROM (SELECT *, {s.u('front_drop')} AS d FROM (SELECT DISTINCT plan_id, variant FROM room{suffix}))""",
        "tfate": f"""SELECT * FROM (SELECT DISTINCT plan_id, variant, type FROM room{suffix} WHERE type <> '{OUTLINE}')
            WHERE {s.u('summary_type', 'type')} < {c.p_summary_type!r}""",
    }


_F0 = fates_sql("0", a.CODE_DEFAULT)


def dropped(spark, sf):
    return a.drop_state(one(spark, sf))


@query("drop_rooms", s.with_ctes("SELECT plan_id, variant, rid, gone, no_type, no_coords FROM rfate", _F0))
def drop_rooms(spark, sf):
    return dropped(spark, sf).select(
        "plan_id", "variant",
        F.expr("inline_outer(zip_with(rooms, room_fate, (r, f) -> named_struct('rid', r.rid, 'gone', f.gone,"
               " 'no_type', f.no_type, 'no_coords', f.no_coords)))"),
    )


@query("orphan_cascade", s.with_ctes(
    """SELECT plan_id, variant, 'edge' AS kind, pos, a, b FROM efate WHERE orphan
       UNION ALL SELECT plan_id, variant, 'rel', pos, a, b FROM sfate WHERE orphan""", _F0))
def orphan_cascade(spark, sf):
    never = a.replace(a.CODE_DEFAULT, p_edge=0.0, p_pair=0.0, p_door=0.0, p_spatial=0.0)
    df = a.drop_state(one(spark, sf), never)
    return df.select("plan_id", "variant", F.expr(
        "inline_outer(concat(filter(transform(edges, (e, i) -> named_struct('kind', if(edge_fate[i].gone, 'edge', ''), 'pos', i,"
        " 'a', e.pair[0], 'b', e.pair[1])), z -> z.kind <> ''),"
        " filter(transform(spatial, (s, i) -> named_struct('kind', if(rel_gone[i], 'rel', ''), 'pos', i,"
        " 'a', s.rid_a, 'b', s.rid_b)), z -> z.kind <> '')))")).filter("kind is not null")


@query("drop_edges", s.with_ctes("SELECT plan_id, variant, pos, gone, pair_mode, kept, door_mode FROM efate", _F0))
def drop_edges(spark, sf):
    return dropped(spark, sf).select(
        "plan_id", "variant",
        F.expr("inline_outer(transform(edge_fate, (f, i) -> named_struct('pos', i, 'gone', f.gone, 'pair_mode', f.pair_mode,"
               " 'kept', f.kept, 'door_mode', f.door_mode)))"),
    ).filter("pos is not null")


@query("drop_spatial", s.with_ctes("SELECT plan_id, variant, pos, orphan OR rolled AS gone FROM sfate", _F0))
def drop_spatial(spark, sf):
    return dropped(spark, sf).select(
        "plan_id", "variant", F.expr("inline_outer(transform(rel_gone, (f, i) -> named_struct('pos', i, 'gone', f)))")
    ).filter("pos is not null")


@query("drop_front_door", s.with_ctes("SELECT plan_id, variant, front_gone, front_bare FROM pfate", _F0))
def drop_front_door(spark, sf):
    return dropped(spark, sf).select("plan_id", "variant", "front_gone", "front_bare")


@query("drop_room_summary", s.with_ctes(
    """SELECT plan_id, variant, total_gone, coalesce(string_agg(type, ',' ORDER BY type), '') AS types_gone
       FROM pfate LEFT JOIN tfate USING (plan_id, variant) GROUP BY ALL""", _F0))
def drop_room_summary(spark, sf):
    return dropped(spark, sf).select(
        "plan_id", "variant", "total_gone", F.array_join("types_gone", ",").alias("types_gone")
    )
