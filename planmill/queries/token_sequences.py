"""Vocabulary, token sequence and text queries."""

from pyspark.sql import functions as F

from planmill.constants import (
    CODE_NAMES, DIRECTIONS, MERGED_NAMES, OUTLINE, PAD_TOKEN, ROOM_TYPES, STRUCTURE_TOKENS,
)
from planmill.functions import tokens as t
from planmill.operators import augment as a
from planmill.operators import render, vocabulary
from planmill.operators import tokenize as tk
from planmill.queries import sql as s
from planmill.queries.augmentation import CHAIN, fates_sql, noise_sql, one, plans
from planmill.queries.registry import query
from planmill.sources import tables

text = lambda c, alias: F.array_join(c, " ").alias(alias)
sql_text = lambda e, alias: F.expr(f"array_join({e}, ' ')").alias(alias)

# --- blocks --------------------------------------------------------------------------------


@query("coord_tokens", s.with_ctes(f"SELECT plan_id, rid, {s.coord_text('coords')} AS tokens FROM room0"))
def coord_tokens(spark, sf):
    return plans(spark, sf).select("plan_id", F.explode("rooms").alias("r")).select(
        "plan_id", "r.rid", sql_text(t.coord_tokens("r.coords"), "tokens")
    )


@query("front_door_block", s.with_ctes(
    f"""SELECT plan_id, CASE WHEN x IS NULL THEN '<FRONT_DOOR> <NO_DOOR> <END_DOOR>'
               ELSE '<FRONT_DOOR> ' || {s.door_text('x', 'y', 'w', 'h')} || ' <END_DOOR>' END AS shown,
               '<FRONT_DOOR> <END_DOOR>' AS bare, '' AS gone
        FROM plan0 LEFT JOIN front0 USING (plan_id, variant)"""))
def front_door_block(spark, sf):
    return plans(spark, sf).select(
        "plan_id",
        sql_text(t.front_door_tokens("front_door"), "shown"),
        sql_text(t.front_door_tokens("front_door", "false", "true"), "bare"),
        sql_text(t.front_door_tokens("front_door", "true", "false"), "gone"),
    )


@query("room_block", s.with_ctes(
    f"""SELECT plan_id, rid, '<ROOM> <RID:' || rid || '> <TYPE:' || type || '> ' || {s.coord_text('coords')} || ' <END_ROOM>' AS shown,
               '<ROOM> <TYPE:' || type || '> ' || {s.coord_text('coords')} || ' <END_ROOM>' AS no_rid,
               '<ROOM> <RID:' || rid || '> ' || {s.coord_text('coords')} || ' <END_ROOM>' AS no_type,
               '<ROOM> <RID:' || rid || '> <TYPE:' || type || '> <END_ROOM>' AS no_coords FROM room0"""))
def room_block(spark, sf):
    return plans(spark, sf).select("plan_id", F.explode("rooms").alias("r")).select(
        "plan_id", "r.rid",
        sql_text(t.room_tokens("r"), "shown"),
        sql_text(t.room_tokens("r", "false"), "no_rid"),
        sql_text(t.room_tokens("r", "true", "true"), "no_type"),
        sql_text(t.room_tokens("r", "true", "false", "true"), "no_coords"),
    )


@query("edge_block", s.with_ctes(
    f"""SELECT plan_id, pos, '<EDGE> <RID:' || a || '> <RID:' || b || '> ' || d || ' <END_EDGE>' AS shown,
               '<EDGE> ' || d || ' <END_EDGE>' AS no_pair, '<EDGE> <RID:' || b || '> ' || d || ' <END_EDGE>' AS one_kept,
               '<EDGE> <RID:' || a || '> <RID:' || b || '> ' || CASE WHEN hd THEN '<DOOR> <SEP_DOOR> <X:' || {s.ri('w')} || '> <Y:' || {s.ri('h')} || '> <END_DOOR>' ELSE d END || ' <END_EDGE>' AS no_place,
               '<EDGE> <RID:' || a || '> <RID:' || b || '> ' || CASE WHEN hd THEN '<DOOR> <X:' || {s.ri('x')} || '> <Y:' || {s.ri('y')} || '> <SEP_DOOR> <END_DOOR>' ELSE d END || ' <END_EDGE>' AS no_size,
               '<EDGE> <RID:' || a || '> <RID:' || b || '> ' || CASE WHEN hd THEN '<DOOR> <SEP_DOOR> <END_DOOR>' ELSE d END || ' <END_EDGE>' AS no_door_info,
               d AS unwrapped
        FROM (SELECT *, CASE WHEN hd THEN '<DOOR> ' || {s.door_text('x', 'y', 'w', 'h')} || ' <END_DOOR>' ELSE '<NO_DOOR>' END AS d FROM edge0)"""))
def edge_block(spark, sf):
    null = "cast(null as string)"
    e = plans(spark, sf).select("plan_id", F.posexplode("edges").alias("pos", "e"))
    return e.select(
        "plan_id", "pos",
        sql_text(t.edge_tokens("e"), "shown"),
        sql_text(t.edge_tokens("e", "'both'"), "no_pair"),
        sql_text(t.edge_tokens("e", "'one'", "e.pair[1]"), "one_kept"),
        sql_text(t.edge_tokens("e", null, "cast(null as int)", "'position'"), "no_place"),
        sql_text(t.edge_tokens("e", null, "cast(null as int)", "'orientation'"), "no_size"),
        sql_text(t.edge_tokens("e", null, "cast(null as int)", "'all'"), "no_door_info"),
        sql_text(t.door_list_tokens("e.door"), "unwrapped"),
    )


@query("relation_item", s.with_ctes(
    "SELECT plan_id, pos, '<SP> <RID:' || a || '> <RID:' || b || '> <REL:' || direction || '> <END_SP>' AS tokens FROM rel0"))
def relation_item(spark, sf):
    return plans(spark, sf).select("plan_id", F.posexplode("spatial").alias("pos", "s")).select(
        "plan_id", "pos", sql_text(t.relation_tokens("s"), "tokens")
    )


def summary_sql(suffix):
    return f"""SELECT plan_id, variant, '<ROOM_SUMMARY>' || CASE WHEN total_gone THEN '' ELSE ' <TOTAL> ' || sum(n) END ||
            coalesce(' ' || string_agg('<TYPE:' || type || '> <COUNT> ' || n, ' ' ORDER BY type) FILTER (shown), '') || ' <END_ROOM_SUMMARY>' AS t
        FROM (SELECT plan_id, variant, type, count(*) AS n, bool_and(NOT EXISTS (SELECT 1 FROM tfate f WHERE f.plan_id = r.plan_id
              AND f.variant = r.variant AND f.type = r.type)) AS shown FROM room{suffix} r WHERE type <> '{OUTLINE}' GROUP BY ALL)
        JOIN pfate USING (plan_id, variant) GROUP BY plan_id, variant, total_gone"""


_NO_FATES = {
    "tfate": "SELECT '' AS plan_id, 0 AS variant, '' AS type WHERE false",
    "pfate": "SELECT plan_id, variant, false AS front_gone, false AS front_bare, false AS total_gone FROM plan0",
    "rfate": "SELECT plan_id, variant, pos, rid, false AS gone, false AS no_type, false AS no_coords FROM room0",
    "efate": "SELECT plan_id, variant, pos, false AS gone, NULL::VARCHAR AS pair_mode, NULL::INTEGER AS kept, NULL::VARCHAR AS door_mode FROM edge0",
    "sfate": "SELECT plan_id, variant, pos, a, b, false AS orphan, false AS rolled FROM rel0",
    "nz": "SELECT '' AS plan_id, 0 AS variant, 0 AS rid, [0] AS noisy WHERE false",
}


@query("room_summary", s.with_ctes("SELECT plan_id, t AS tokens FROM summ", {**_NO_FATES, "summ": summary_sql("0")}))
def room_summary(spark, sf):
    return a.keep_everything(plans(spark, sf)).select("plan_id", sql_text(tk.summary_tokens(), "tokens"))


_CANON = f"""SELECT plan_id, variant, rid, row_number() OVER (PARTITION BY plan_id, variant ORDER BY cy, cx, pos)::INTEGER AS k
    FROM (SELECT *, {s.mean(s.ys('coords'))} AS cy, {s.mean(s.xs('coords'))} AS cx FROM room@ WHERE type <> '{OUTLINE}')"""


@query("canonical_room_order", s.with_ctes("SELECT plan_id, rid, k FROM canon", {"canon": _CANON.replace("@", "0")}))
def canonical_room_order(spark, sf):
    return tk.canonical_rooms(plans(spark, sf)).select("plan_id", F.posexplode_outer("canon_rooms").alias("p", "r")).select(
        "plan_id", "r.rid", (F.col("p") + 1).alias("k")
    ).filter("k is not null")


_CEDGE = "SELECT *, row_number() OVER (PARTITION BY plan_id, variant ORDER BY least(a, b), greatest(a, b), pos)::INTEGER AS k FROM edge@"


@query("canonical_edge_order", s.with_ctes(
    "SELECT plan_id, a, b, k FROM cedge", {**{k: v for k, v in CHAIN.items()}, "cedge": _CEDGE.replace("@", "4")}))
def canonical_edge_order(spark, sf):
    df = one(spark, sf)
    for _, step in a.transform_steps(a.SFT)[:4]:
        df = df.transform(step)
    return tk.canonical_edges(df).select("plan_id", F.posexplode_outer("canon_edges").alias("p", "e")).select(
        "plan_id", F.expr("e.pair[0]").alias("a"), F.expr("e.pair[1]").alias("b"), (F.col("p") + 1).alias("k")
    ).filter("k is not null")


# --- sequences -----------------------------------------------------------------------------

def front_text(shown="false", bare="false"):
    return (
        f"CASE WHEN {shown} THEN NULL WHEN {bare} THEN '<FRONT_DOOR> <END_DOOR>'"
        f" WHEN f.x IS NULL THEN '<FRONT_DOOR> <NO_DOOR> <END_DOOR>'"
        f" ELSE '<FRONT_DOOR> ' || {s.door_text('f.x', 'f.y', 'f.w', 'f.h')} || ' <END_DOOR>' END"
    )


def condition_sql(suffix):
    """CTEs ending in `cond` (plan_id, variant, t); needs the fate CTEs and `nz`."""
    place = f"CASE WHEN coalesce(door_mode, '') IN ('position', 'all') THEN '' ELSE '<X:' || {s.ri('x')} || '> <Y:' || {s.ri('y')} || '> ' END"
    size = f"CASE WHEN coalesce(door_mode, '') IN ('orientation', 'all') THEN '' ELSE '<X:' || {s.ri('w')} || '> <Y:' || {s.ri('h')} || '> ' END"
    return {
        "summ": summary_sql(suffix),
        "croom": f"""SELECT plan_id, variant, string_agg('<ROOM> <RID:' || r.rid || '> ' ||
              CASE WHEN no_type THEN '' ELSE '<TYPE:' || r.type || '> ' END ||
              CASE WHEN no_coords THEN '' ELSE {s.coord_text('coalesce(noisy, coords)')} || ' ' END || '<END_ROOM>', ' ' ORDER BY pos) AS t
            FROM room{suffix} r JOIN rfate USING (plan_id, variant, pos) LEFT JOIN nz ON nz.plan_id = r.plan_id AND nz.variant = r.variant AND nz.rid = r.rid
            WHERE NOT gone GROUP BY ALL""".replace("SELECT plan_id, variant,", "SELECT r.plan_id, r.variant,").replace("'<TYPE:' || r.type", "'<TYPE:' || r.type"),
        "cedge": f"""SELECT plan_id, variant, string_agg('<EDGE> ' || CASE WHEN pair_mode = 'both' THEN '' WHEN pair_mode = 'one' THEN '<RID:' || kept || '> '
              ELSE '<RID:' || e.a || '> <RID:' || e.b || '> ' END || CASE WHEN hd THEN '<DOOR> ' || {place} || '<SEP_DOOR> ' || {size} || '<END_DOOR>'
              ELSE '<NO_DOOR>' END || ' <END_EDGE>', ' ' ORDER BY pos) AS t
            FROM edge{suffix} e JOIN efate USING (plan_id, variant, pos) WHERE NOT gone GROUP BY ALL""",
        "crel": f"""SELECT plan_id, variant, string_agg('<SP> <RID:' || r.a || '> <RID:' || r.b || '> <REL:' || direction || '> <END_SP>', ' ' ORDER BY pos) AS t
            FROM rel{suffix} r JOIN sfate USING (plan_id, variant, pos) WHERE NOT (orphan OR rolled) GROUP BY ALL""",
        "cond": f"""SELECT p.plan_id, p.variant, concat_ws(' ', '<INPUT>', summ.t, {front_text('front_gone', 'front_bare')}, croom.t, cedge.t, crel.t, '<END_INPUT>') AS t
            FROM pfate p JOIN summ USING (plan_id, variant) LEFT JOIN front{suffix} f USING (plan_id, variant) LEFT JOIN croom USING (plan_id, variant)
            LEFT JOIN cedge USING (plan_id, variant) LEFT JOIN crel USING (plan_id, variant)""",
    }


def answer_sql(suffix):
    """CTEs ending in `answ` (plan_id, variant, t)."""
    return {
        "canon": _CANON.replace("@", suffix),
        "cedg2": _CEDGE.replace("@", suffix),
        "aroom": f"""SELECT plan_id, variant, string_agg('<ROOM> <TYPE:' || type || '> ' || {s.coord_text('coords')} || ' <END_ROOM>', ' ' ORDER BY coalesce(k, 0)) AS t
            FROM room{suffix} LEFT JOIN canon USING (plan_id, variant, rid) GROUP BY ALL""",
        "adoor": f"""SELECT plan_id, variant, string_agg(CASE WHEN hd THEN '<DOOR> ' || {s.door_text('x', 'y', 'w', 'h')} || ' <END_DOOR>' ELSE '<NO_DOOR>' END, ' ' ORDER BY k) AS t
            FROM cedg2 GROUP BY ALL""",
        "answ": f"""SELECT plan_id, variant, concat_ws(' ', '<OUTPUT>', {front_text()}, aroom.t, adoor.t, '<END_OUTPUT>') AS t
            FROM aroom LEFT JOIN front{suffix} f USING (plan_id, variant) LEFT JOIN adoor USING (plan_id, variant)""",
    }


COND0 = {**_NO_FATES, **condition_sql("0")}
ANSW0 = answer_sql("0")


@query("answer_tokens", s.with_ctes(
    "SELECT plan_id, t AS tokens, len(string_split(t, ' '))::INTEGER AS n_tokens FROM answ", ANSW0))
def answer_tokens(spark, sf):
    return tk.answer_tokens(plans(spark, sf)).select("plan_id", text("answer", "tokens"), F.size("answer").alias("n_tokens"))


@query("condition_tokens_full", s.with_ctes("SELECT plan_id, t AS tokens FROM cond", COND0))
def condition_tokens_full(spark, sf):
    return tk.condition_tokens(a.keep_everything(plans(spark, sf))).select("plan_id", text("condition", "tokens"))


_DROP0 = {**fates_sql("0", a.CODE_DEFAULT), "nz": noise_sql("0", 0.30, 3.0), **condition_sql("0")}


@query("condition_tokens_dropped", s.with_ctes("SELECT plan_id, t AS tokens FROM cond", _DROP0))
def condition_tokens_dropped(spark, sf):
    df = a.coord_noise(a.drop_state(one(spark, sf)))
    return tk.condition_tokens(df).select("plan_id", text("condition", "tokens"))


_LAST = str(len(a.transform_steps(a.SFT)))
_AUG = {
    **CHAIN, **fates_sql(_LAST, a.SFT), "nz": noise_sql(_LAST, a.SFT.p_noise, a.SFT.sigma),
    **condition_sql(_LAST), **answer_sql(_LAST),
}


def augmented(spark, sf, n=1, cfg=a.SFT):
    df = a.augment(a.expand_variants(plans(spark, sf), n, cfg.seed), cfg)
    return tk.answer_tokens(tk.condition_tokens(df))


@query("augmented_pairs", s.with_ctes(
    "SELECT c.plan_id, c.variant, c.t AS condition, w.t AS answer FROM cond c JOIN answ w USING (plan_id, variant)", _AUG))
def augmented_pairs(spark, sf):
    return augmented(spark, sf).select("plan_id", "variant", text("condition", "condition"), text("answer", "answer"))


_SUMMARY_SQL = {
    "srid": f"""SELECT plan_id, variant, '[' || string_agg(rid, ', ' ORDER BY rid) FILTER (gone) || ']' AS gone,
          '[' || string_agg(rid, ', ' ORDER BY rid) FILTER (no_type) || ']' AS no_type, '[' || string_agg(rid, ', ' ORDER BY rid) FILTER (no_coords) || ']' AS no_coords
        FROM rfate GROUP BY ALL""",
    "snz": "SELECT plan_id, variant, '[' || string_agg(rid, ', ' ORDER BY rid) || ']' AS noisy FROM nz GROUP BY ALL",
    "sedge": """SELECT plan_id, variant, '[' || string_agg(pos, ', ' ORDER BY pos) FILTER (gone) || ']' AS gone,
          '{' || string_agg(pos || ': ' || CASE WHEN pair_mode = 'both' THEN '''both''' ELSE '(''one'', ' || kept || ')' END, ', ' ORDER BY pos) FILTER (pair_mode IS NOT NULL) || '}' AS pairs,
          '{' || string_agg(pos || ': ''' || door_mode || '''', ', ' ORDER BY pos) FILTER (door_mode IS NOT NULL) || '}' AS doors FROM efate GROUP BY ALL""",
    "srel": "SELECT plan_id, variant, '[' || string_agg(pos, ', ' ORDER BY pos) FILTER (orphan OR rolled) || ']' AS gone FROM sfate GROUP BY ALL",
    "styp": "SELECT plan_id, variant, '[' || string_agg('''' || type || '''', ', ' ORDER BY type) || ']' AS gone FROM tfate GROUP BY ALL",
}


@query("augment_summary", s.with_ctes(
    f"""SELECT p.plan_id, p.variant, concat_ws(', ', {', '.join("'" + k + "'" for k, _ in a.transform_steps(a.SFT))},
          'CoordNoise(rids=' || noisy || ')', 'DropBlock(rids=' || srid.gone || ')', 'DropType(rids=' || no_type || ')', 'DropCoords(rids=' || no_coords || ')',
          'DropEdge(idxs=' || sedge.gone || ')', 'DropEdgePair(' || pairs || ')', 'DropEdgeDoor(' || doors || ')', 'DropSpatial(idxs=' || srel.gone || ')',
          CASE WHEN front_gone THEN 'DropFrontDoor' END, CASE WHEN front_bare THEN 'DropFrontDoorCoords' END,
          CASE WHEN total_gone THEN 'DropRoomSummaryTotal' END, 'DropRoomSummaryType(types=' || styp.gone || ')') AS summary
        FROM pfate p LEFT JOIN srid USING (plan_id, variant) LEFT JOIN snz USING (plan_id, variant) LEFT JOIN sedge USING (plan_id, variant)
        LEFT JOIN srel USING (plan_id, variant) LEFT JOIN styp USING (plan_id, variant)""", {**_AUG, **_SUMMARY_SQL}))
def augment_summary(spark, sf):
    df = a.augment(a.expand_variants(plans(spark, sf), 1), a.SFT)
    return a.augment_summary(df, a.SFT).select("plan_id", "variant", "summary")


@query("drop_applied_view", s.with_ctes(
    """SELECT plan_id, 'room' AS kind, rid::VARCHAR AS k, CASE WHEN no_type THEN 'unknown' ELSE r.type END || ':' ||
          CASE WHEN no_coords THEN '' ELSE array_to_string(coalesce(noisy, coords), ',') END AS val
        FROM room0 r JOIN rfate f USING (plan_id, variant, rid) LEFT JOIN nz USING (plan_id, variant, rid) WHERE NOT gone
      UNION ALL SELECT plan_id, 'edge', a || '-' || b, CASE WHEN hd AND coalesce(mode, '') <> 'all' THEN '1' ELSE '0' END
        FROM (SELECT e.plan_id, e.a, e.b, hd, q.door_mode AS mode FROM
                (SELECT x.*, row_number() OVER (PARTITION BY x.plan_id ORDER BY x.pos) - 1 AS np FROM edge0 x JOIN efate f USING (plan_id, variant, pos) WHERE NOT f.gone) e
              LEFT JOIN efate q ON q.plan_id = e.plan_id AND q.pos = e.np)
      UNION ALL SELECT plan_id, 'rel', r.a || '-' || r.b, direction FROM rel0 r JOIN sfate USING (plan_id, variant, pos) WHERE NOT (orphan OR rolled)
      UNION ALL SELECT plan_id, 'front', '0', x::INTEGER::VARCHAR FROM front0 JOIN pfate USING (plan_id, variant) WHERE NOT (front_gone OR front_bare)""", _DROP0))
def drop_applied_view(spark, sf):
    from planmill.operators.normalize import drop_applied_view as view

    df = view(a.coord_noise(a.drop_state(one(spark, sf))))
    return df.select("plan_id", F.expr(
        "inline_outer(concat(transform(rooms, r -> named_struct('kind', 'room', 'k', cast(r.rid as string), 'val',"
        " concat(r.type, ':', array_join(transform(r.coords, v -> cast(v as string)), ',')))),"
        " transform(edges, e -> named_struct('kind', 'edge', 'k', concat(cast(e.pair[0] as string), '-', cast(e.pair[1] as string)), 'val', cast(size(e.door) as string))),"
        " transform(spatial, s -> named_struct('kind', 'rel', 'k', concat(cast(s.rid_a as string), '-', cast(s.rid_b as string)), 'val', s.direction)),"
        " transform(front_door, d -> named_struct('kind', 'front', 'k', '0', 'val', cast(cast(d.x as int) as string)))))")).filter("kind is not null")


_LENS = {
    "lens": "SELECT 'answer' AS kind, len(string_split(t, ' '))::INTEGER AS l FROM answ UNION ALL SELECT 'condition', len(string_split(t, ' '))::INTEGER FROM cond",
    "lcum": "SELECT kind, l, sum(count(*)) OVER (PARTITION BY kind ORDER BY l) AS so_far, sum(count(*)) OVER (PARTITION BY kind) AS n FROM lens GROUP BY kind, l",
}
_LEAST = "(min(l) FILTER (so_far >= ceil(n * {}::DOUBLE)))::INTEGER AS {}"


@query("sequence_stats", s.with_ctes(
    f"""SELECT kind, n, min_len, max_len, total_len, avg_len, p50_len, p95_len, p99_len FROM
        (SELECT kind, count(*) AS n, min(l) AS min_len, max(l) AS max_len, sum(l)::BIGINT AS total_len, round(avg(l), 6) AS avg_len FROM lens GROUP BY 1)
        JOIN (SELECT kind, {_LEAST.format(0.5, "p50_len")}, {_LEAST.format(0.95, "p95_len")}, {_LEAST.format(0.99, "p99_len")} FROM lcum GROUP BY 1) USING (kind)""",
    {**ANSW0, **COND0, **_LENS}))
def sequence_stats(spark, sf):
    df = tk.condition_tokens(a.keep_everything(tk.answer_tokens(plans(spark, sf))))
    kinds = [tk.sequence_stats(df, c).withColumn("kind", F.lit(c)) for c in ("answer", "condition")]
    return kinds[0].unionByName(kinds[1])


# --- vocabulary ------------------------------------------------------------------------------

_VOC = f"""SELECT (row_number() OVER (ORDER BY g, k) - 1)::INTEGER AS ord, category, token FROM (
      SELECT 1 AS g, 'coord_x' AS category, k, '<X:' || k || '>' AS token FROM range(256) r(k)
      UNION ALL SELECT 2, 'coord_y', k, '<Y:' || k || '>' FROM range(256) r(k)
      UNION ALL SELECT 3, 'room_id', k, '<RID:' || k || '>' FROM range(16) r(k)
      UNION ALL SELECT 4, 'room_type', k, '<TYPE:' || w || '>' FROM (SELECT unnest({s.names([*ROOM_TYPES, OUTLINE])}) AS w, unnest(range({len(ROOM_TYPES) + 1})) AS k)
      UNION ALL SELECT 5, 'spatial_rel', k, '<REL:' || w || '>' FROM (SELECT unnest({s.names(DIRECTIONS)}) AS w, unnest(range(8)) AS k)
      UNION ALL SELECT 6, 'structure_special', 0, '{PAD_TOKEN}'
      UNION ALL SELECT 7, 'structure', k, w FROM (SELECT unnest({s.names(STRUCTURE_TOKENS)}) AS w, unnest(range({len(STRUCTURE_TOKENS)})) AS k))"""
_BASE = "SELECT CASE WHEN c_custkey % 100 = 7 THEN '<X:' || (c_custkey // 100) || '>' ELSE c_name END AS token, c_custkey AS id FROM customer"
_IDS = f"""SELECT v.ord, category, token, coalesce(b.id, (SELECT max(id) + 1 FROM basev) - 1 +
      row_number() OVER (PARTITION BY b.id IS NULL ORDER BY (token <> '{PAD_TOKEN}')::INTEGER, ord))::INTEGER AS id FROM voc v LEFT JOIN basev b USING (token)"""
VOCAB_SQL = {"voc": _VOC, "basev": _BASE, "vids": _IDS}


def base_vocabulary(spark, sf):
    """(token, id) of customers, some of which already carry a coordinate token."""
    return tables.table(spark, sf, "customer").select(
        F.expr("if(c_custkey % 100 = 7, concat('<X:', cast(c_custkey div 100 as string), '>'), c_name)").alias("token"),
        F.col("c_custkey").alias("id"),
    )


def vocabulary_table(spark, sf):
    return vocabulary.assign_ids(vocabulary.token_table(spark), base_vocabulary(spark, sf))


@query("final_room_types", s.with_ctes(
    f"""SELECT DISTINCT {s.names([MERGED_NAMES.get(n, n) for n in CODE_NAMES.values()])}[l_partkey % 13 + 1] AS type FROM lineitem""".strip()))
def final_room_types(spark, sf):
    from planmill.operators.normalize import final_types, merge_types

    codes = tables.table(spark, sf, "lineitem").select((F.col("l_partkey") % 13).cast("int").alias("code"))
    return final_types(merge_types(codes))


@query("token_ids", s.with_ctes("SELECT ord, category, token, id FROM vids", VOCAB_SQL))
def token_ids(spark, sf):
    return vocabulary_table(spark, sf)


@query("token_table", s.with_ctes("SELECT v.ord, category, token, count(c_custkey) AS n_in_base FROM voc v LEFT JOIN customer ON token = '<X:' || (c_custkey // 100) || '>' AND c_custkey % 100 = 7 GROUP BY ALL", VOCAB_SQL))
def token_table(spark, sf):
    base = base_vocabulary(spark, sf).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.token_table(spark).join(base, "token", "left").select(
        "ord", "category", "token", F.coalesce("n", F.lit(0)).cast("long").alias("n_in_base")
    )


_ENC = {**ANSW0, **VOCAB_SQL, "exploded": "SELECT plan_id, unnest(string_split(t, ' ')) AS token, unnest(range(len(string_split(t, ' ')))) AS pos FROM answ"}


@query("encode_tokens", s.with_ctes(
    "SELECT plan_id, string_agg(id, ',' ORDER BY pos) AS ids, count(*)::INTEGER AS n FROM exploded LEFT JOIN vids USING (token) GROUP BY 1", _ENC))
def encode_tokens(spark, sf):
    codec = vocabulary.Codec(vocabulary_table(spark, sf))
    df = tk.answer_tokens(plans(spark, sf)).withColumn("ids", codec.encode("answer"))
    good, _ = vocabulary.split_unknown(df, "ids")
    return good.select("plan_id", F.expr("array_join(transform(ids, i -> cast(i as string)), ',')").alias("ids"), F.size("ids").alias("n"))


@query("decode_tokens", s.with_ctes(
    "SELECT plan_id, t || ' <UNK:-5>' AS tokens FROM answ", ANSW0))
def decode_tokens(spark, sf):
    vocab = vocabulary_table(spark, sf)
    df = tk.answer_tokens(plans(spark, sf)).withColumn("ids", vocabulary.Codec(vocab).encode("answer"))
    df = df.withColumn("ids", F.concat("ids", F.array(F.lit(-5))))
    return vocabulary.lookup_tokens(df, "ids", vocab).select("plan_id", text("tokens", "tokens"))


def number_table(spark, sf):
    """(n, ids): the base vocabulary's ids of the numbers 0..15, one for each digit."""
    digits = tables.table(spark, sf, "customer").filter("c_custkey between 10 and 19").select(
        (F.col("c_custkey") - 10).cast("string").alias("d"), F.col("c_custkey").cast("int").alias("id"))
    chars = spark.range(16).select(F.col("id").alias("n"), F.posexplode(F.expr("regexp_extract_all(cast(id as string), '[0-9]', 0)")).alias("pos", "d"))
    return chars.join(digits, "d").groupBy("n").agg(F.expr("transform(array_sort(collect_list(struct(pos, id))), z -> z.id)").alias("ids"))


_CENC = {
    **COND0, **VOCAB_SQL,
    "ctok": "SELECT plan_id, unnest(string_split(t, ' ')) AS token, unnest(range(len(string_split(t, ' '))))::INTEGER AS pos FROM cond",
    "cids": """SELECT plan_id, pos, NOT starts_with(token, '<') AS num, CASE WHEN starts_with(token, '<') THEN [id::INTEGER]
        ELSE list_transform(string_split(token, ''), lambda d: 10 + d::INTEGER) END AS l FROM ctok LEFT JOIN vids USING (token)""",
    "coff": "SELECT *, (sum(len(l)) OVER (PARTITION BY plan_id ORDER BY pos) - len(l))::INTEGER AS f FROM cids",
}


@query("encode_conditions", s.with_ctes(
    """SELECT plan_id, count(*)::INTEGER AS n_tokens, sum(len(l))::INTEGER AS n_ids, md5(string_agg(array_to_string(l, ','), ',' ORDER BY pos)) AS ids,
          coalesce(string_agg(array_to_string(range(f, f + len(l)), ','), ',' ORDER BY pos) FILTER (num), '') AS number_ids,
          coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (num), '') AS number_tokens FROM coff GROUP BY 1""", _CENC))
def encode_conditions(spark, sf):
    """Whole conditions as ids, numbers as several; places of the numbers among the ids, and back among the tokens."""
    codec = vocabulary.Codec(vocabulary_table(spark, sf), number_table(spark, sf))
    df = tk.condition_tokens(a.keep_everything(plans(spark, sf))).select("plan_id", "condition")
    good, _ = vocabulary.split_unknown(codec.with_encoded(df, "condition"), "ids")
    numbers = "filter(transform(condition, (t, i) -> if(startswith(t, '<'), -1, i)), i -> i >= 0)"
    there = good.withColumn("at", F.expr(vocabulary.places_of_tokens(numbers)))
    joined = lambda v: f"array_join(transform({v}, z -> cast(z as string)), ',')"
    return there.select(
        "plan_id", F.size("condition").alias("n_tokens"), F.size("ids").alias("n_ids"), F.md5(F.expr(joined("ids"))).alias("ids"),
        F.expr(joined("at")).alias("number_ids"), F.expr(joined(vocabulary.tokens_of_places("at"))).alias("number_tokens"))


# --- text ------------------------------------------------------------------------------------

def layout_sql(source):
    """CTEs laying out the text column t of `source`; end in `laid` (plan_id, variant, lines)."""
    return {
        "tk": f"SELECT plan_id, variant, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS i FROM {source}",
        "tk2": """SELECT *, sum((w = '<EDGE>')::INTEGER - (w = '<END_EDGE>')::INTEGER) OVER q AS in_edge,
              lag(w) OVER q AS pw FROM tk WINDOW q AS (PARTITION BY plan_id, variant ORDER BY i)""",
        "tk3": """SELECT *, (w IN ('<ROOM>', '<EDGE>', '<SP>', '<FRONT_DOOR>', '<INPUT>', '<OUTPUT>', '<END_INPUT>', '<END_OUTPUT>')
              OR (w = '<DOOR>' AND in_edge = 0) OR pw IN ('<INPUT>', '<OUTPUT>', '<END_ROOM>', '<END_EDGE>', '<END_SP>')
              OR (pw = '<END_DOOR>' AND in_edge = 0)) AND NOT (w = '<END_EDGE>') AS starts FROM tk2""",
        "tk4": "SELECT *, sum(starts::INTEGER) OVER (PARTITION BY plan_id, variant ORDER BY i) AS ln FROM tk3",
        "tk5": "SELECT plan_id, variant, ln, string_agg(w, ' ' ORDER BY i) AS l FROM tk4 GROUP BY ALL",
        "laid": """SELECT plan_id, variant, string_agg(CASE WHEN l IN ('<INPUT>', '<OUTPUT>') OR l LIKE '<END_INPUT>%' OR l LIKE '<END_OUTPUT>%' THEN l ELSE '  ' || l END, chr(10) ORDER BY ln) AS lines
            FROM tk5 GROUP BY ALL""",
    }


@query("token_layout", s.with_ctes(
    "SELECT plan_id, lines FROM laid", {**_DROP0, **layout_sql("cond")}))
def token_layout(spark, sf):
    df = tk.condition_tokens(a.coord_noise(a.drop_state(one(spark, sf))))
    return df.select("plan_id", F.expr(render.layout("condition")).alias("lines"))


def _dt(x, y, w, h):
    return f"'x=' || {s.ri(x)} || ' y=' || {s.ri(y)} || CASE WHEN {w} >= {h} THEN ' H(w=' ELSE ' V(w=' END || {s.ri(w)} || ',h=' || {s.ri(h)} || ')'"


PLAN_TEXT_SQL = {
    "ptext": f"""SELECT plan_id, concat_ws(chr(10), 'rooms:', (SELECT string_agg(printf('  rid=%-3d  type=%-15s  coords=[', rid, type) ||
            array_to_string(list_transform(range(1, len(coords) // 2 + 1), lambda k: '(' || coords[2*k-1] || ',' || coords[2*k] || ')'), ' ') || ']', chr(10) ORDER BY pos)
            FROM room0 r WHERE r.plan_id = p.plan_id), 'edges:',
          (SELECT string_agg('  [' || a || ',' || b || ']  ' || CASE WHEN hd THEN 'door: ' || {_dt('x', 'y', 'w', 'h')} ELSE 'no_door' END, chr(10) ORDER BY pos) FROM edge0 e WHERE e.plan_id = p.plan_id),
          coalesce((SELECT 'front_door: ' || {_dt('x', 'y', 'w', 'h')} FROM front0 f WHERE f.plan_id = p.plan_id), 'front_door: None'), 'spatial:',
          (SELECT string_agg('  ' || a || '→' || b || '  ' || direction, chr(10) ORDER BY pos) FROM rel0 s WHERE s.plan_id = p.plan_id)) AS dump FROM plan0 p"""
}


@query("plan_text", s.with_ctes("SELECT plan_id, dump FROM ptext", PLAN_TEXT_SQL))
def plan_text(spark, sf):
    return plans(spark, sf).select("plan_id", F.expr(render.plan_text()).alias("dump"))


@query("sample_report")
def sample_report(spark, sf):
    """Reports of every plan with two variants each; the parts are checked by the queries above."""
    base = plans(spark, sf).withColumn("sample_no", F.col("plan_id").cast("long"))
    base = tk.condition_tokens(a.keep_everything(base)).withColumn("origin_text", F.expr(render.layout("condition")))
    base = base.drop("condition", "room_fate", "edge_fate", "rel_gone", "front_gone", "front_bare", "total_gone", "types_gone")
    df = a.augment_summary(a.augment(a.expand_variants(base, 2), a.SFT), a.SFT)
    df = tk.answer_tokens(tk.condition_tokens(df)).withColumns(
        {"input_text": F.expr(render.layout("condition")), "output_text": F.expr(render.layout("answer"))}
    )
    return render.sample_report(df, 2).select("sample_no", "variant", "report")
