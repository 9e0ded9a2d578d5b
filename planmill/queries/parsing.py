"""Parsing queries over four answer sequences per plan and over dropped conditions."""

from pyspark.sql import functions as F

from planmill.functions import tokens as t
from planmill.operators import augment as a
from planmill.operators import parse
from planmill.operators import tokenize as tk
from planmill.queries import sql as s
from planmill.queries.augmentation import digest_sql, digests, one, plans
from planmill.queries.registry import query
from planmill.queries.token_sequences import _DROP0, answer_sql
from planmill.sources.completions import completions

_SHIFT = "list_transform(coords, lambda v, i: CASE WHEN i % 2 = 1 THEN v + 20 ELSE v END)"

COMP_SQL = {
    "gens": "SELECT unnest(range(4))::INTEGER AS g",
    "roomG": f"""SELECT r.plan_id, g AS variant, pos, rid, type,
          CASE WHEN g = 1 AND rid = 1 + r.plan_id::BIGINT % n THEN {_SHIFT} ELSE coords END AS coords
        FROM room0 r JOIN outl USING (plan_id) CROSS JOIN gens WHERE NOT (g = 2 AND rid >= n)""",
    "edgeG": "SELECT * REPLACE (g AS variant) FROM edge0 CROSS JOIN gens",
    "frontG": "SELECT * REPLACE (g AS variant) FROM front0 CROSS JOIN gens",
    **answer_sql("G"),
    "splt": "SELECT plan_id, variant, string_split(t, ' ') AS l FROM answ",
    "comp": """SELECT plan_id, variant, CASE WHEN variant < 3 THEN l
          WHEN plan_id::BIGINT % 2 = 0 THEN l[1:e - 1] || l[e + 1:] ELSE l[1:x - 1] || [l[x + 1], l[x]] || l[x + 2:] END AS l
        FROM (SELECT *, list_position(l, '<END_ROOM>') AS e, list_position(list_transform(l, lambda w: starts_with(w, '<X:')), true) AS x FROM splt)""",
}

_R = "R(?:t[^RrDdnEF]*|(?:[^tr][^r]*)?)r?"
_WORDS = {
    "<ROOM>": "R", "<END_ROOM>": "r", "<DOOR>": "D", "<END_DOOR>": "d", "<SEP_DOOR>": "s", "<NO_DOOR>": "n",
    "<FRONT_DOOR>": "F", "<OUTPUT>": "O", "<END_OUTPUT>": "E", "<EOS>": "e",
}


def _door_errors(text, st):
    lead = f"CASE WHEN {text}[2:3] = 'xy' THEN 2 WHEN {text}[2] IN ('x', 'y') THEN 1 ELSE 0 END"
    return (
        f"SELECT plan_id, variant, {st} + 1 + {lead} AS i FROM @ WHERE {text} NOT LIKE '%s%'"
        f" UNION ALL SELECT plan_id, variant, {st} + len({text}) FROM @ WHERE {text} NOT LIKE '%d'"
    )


STRICT_SQL = {
    **COMP_SQL,
    "ctok": "SELECT plan_id, variant, unnest(l) AS w, unnest(range(len(l)))::INTEGER AS i FROM comp",
    "clet": f"""SELECT *, lag(c) OVER q AS pc, lead(c) OVER q AS nc FROM (SELECT *, CASE WHEN w LIKE '<X:%' THEN 'x' WHEN w LIKE '<Y:%' THEN 'y'
          WHEN w LIKE '<TYPE:%' THEN 't' {' '.join(f"WHEN w = '{k}' THEN '{v}'" for k, v in _WORDS.items())} ELSE '?' END AS c FROM ctok)
        WINDOW q AS (PARTITION BY plan_id, variant ORDER BY i)""",
    "cstr": "SELECT plan_id, variant, string_agg(c, '' ORDER BY i) AS s FROM clet GROUP BY ALL",
    "cfd": "SELECT *, regexp_extract(substr(s, o + 1), '^(?:F(?:nd?|x?y?s?x?y?d?))?') AS fd FROM (SELECT *, instr(s, 'O') AS o FROM cstr)",
    "crs": f"SELECT *, o + len(fd) AS r0, regexp_extract(substr(s, o + len(fd) + 1), '^(?:{_R})*') AS rs FROM cfd",
    "cds": "SELECT *, r0 + len(rs) AS d0, regexp_extract(substr(s, r0 + len(rs) + 1), '^[^Ee]*') AS ds FROM crs",
    "crb": f"""SELECT *, r0 + coalesce(sum(len(b)) OVER (PARTITION BY plan_id, variant ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
        FROM (SELECT plan_id, variant, r0, unnest(regexp_extract_all(rs, '{_R}')) AS b, unnest(range(len(regexp_extract_all(rs, '{_R}')))) AS k FROM cds)""",
    "cdb": """SELECT *, d0 + coalesce(sum(len(b)) OVER (PARTITION BY plan_id, variant ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
        FROM (SELECT plan_id, variant, d0, unnest(regexp_extract_all(ds, 'Dx?y?s?x?y?d?|n|[^Dn]')) AS b, unnest(range(len(regexp_extract_all(ds, 'Dx?y?s?x?y?d?|n|[^Dn]')))) AS k FROM cds)""",
    "crt": "SELECT *, st + len(b) - CASE WHEN b LIKE '%r' THEN 2 ELSE 1 END AS last FROM crb WHERE b LIKE 'Rt%'",
    "cin": "SELECT r.plan_id, r.variant, r.k, r.last, c.i, c.w, c.c, c.pc, c.nc FROM crt r JOIN clet c ON c.plan_id = r.plan_id AND c.variant = r.variant AND c.i BETWEEN r.st + 2 AND r.last",
    "cvx": "SELECT * FROM cin WHERE c = 'x' AND i < last AND nc = 'y'",
    "cshort": "SELECT r.* FROM crt r LEFT JOIN (SELECT plan_id, variant, k, count(*) AS nv FROM cvx GROUP BY ALL) USING (plan_id, variant, k) WHERE coalesce(nv, 0) < 4",
    "fdd": "SELECT * FROM cfd WHERE fd LIKE 'F%' AND fd NOT LIKE 'Fn%'",
    "ddd": "SELECT * FROM cdb WHERE b LIKE 'D%'",
    "cerr": f"""SELECT DISTINCT plan_id, variant, i::INTEGER AS i FROM (
          {_door_errors('fd', 'o').replace('@', 'fdd')} UNION ALL {_door_errors('b', 'st').replace('@', 'ddd')}
          UNION ALL SELECT plan_id, variant, st FROM crb WHERE b NOT LIKE 'Rt%'
          UNION ALL SELECT plan_id, variant, st + len(b) FROM crt WHERE b NOT LIKE '%r'
          UNION ALL SELECT plan_id, variant, i FROM cin WHERE CASE c WHEN 'x' THEN i = last OR nc <> 'y' WHEN 'y' THEN pc <> 'x' ELSE true END
          UNION ALL SELECT plan_id, variant, unnest(range(st::BIGINT, (st + len(b))::BIGINT)) FROM cshort
          UNION ALL SELECT plan_id, variant, st FROM cdb WHERE b NOT LIKE 'D%' AND b <> 'n')""",
    "pres": """SELECT c.plan_id, c.variant, coalesce(nr, 0)::INTEGER AS n_rooms, coalesce(nv, 0)::INTEGER AS n_points, coalesce(nd, 0)::INTEGER AS n_doors, coalesce(errs, '') AS errors,
          CASE WHEN coalesce(nr, 0) = 0 THEN 1 WHEN errs IS NOT NULL THEN 2 ELSE 3 END::INTEGER AS level
        FROM cfd c LEFT JOIN (SELECT plan_id, variant, count(*) AS nr FROM crt GROUP BY ALL) USING (plan_id, variant)
        LEFT JOIN (SELECT plan_id, variant, count(*) AS nv FROM cvx GROUP BY ALL) USING (plan_id, variant)
        LEFT JOIN (SELECT plan_id, variant, count(*) AS nd FROM ddd WHERE b IN ('Dxysxyd', 'Dxysxy', 'Dxyxyd', 'Dxyxy') GROUP BY ALL) USING (plan_id, variant)
        LEFT JOIN (SELECT plan_id, variant, string_agg(i, ',' ORDER BY i) AS errs FROM cerr GROUP BY ALL) USING (plan_id, variant)""",
}


def comps(spark, sf):
    return completions(plans(spark, sf))


@query("parse_strict", s.with_ctes(
    "SELECT plan_id, variant AS gen_idx, level, n_rooms, n_points, n_doors, errors FROM pres", STRICT_SQL))
def parse_strict(spark, sf):
    return parse.parse_strict(comps(spark, sf)).select(
        "plan_id", "gen_idx", "parsed.level", F.size("parsed.rooms").alias("n_rooms"),
        F.expr("aggregate(parsed.rooms, 0, (s, r) -> s + size(r.points))").alias("n_points"),
        F.expr("size(filter(parsed.doors, d -> d.door is not null))").alias("n_doors"),
        F.expr("array_join(transform(parsed.errors, i -> cast(i as string)), ',')").alias("errors"),
    )


@query("parse_strict_vertices", s.with_ctes(
    """SELECT v.plan_id, v.variant AS gen_idx, (dense_rank() OVER (PARTITION BY v.plan_id, v.variant ORDER BY v.k) - 1)::INTEGER AS room, v.i AS token_index,
          regexp_extract(v.w, '[0-9]+')::INTEGER AS x, regexp_extract(y.w, '[0-9]+')::INTEGER AS y
       FROM cvx v JOIN ctok y ON y.plan_id = v.plan_id AND y.variant = v.variant AND y.i = v.i + 1""", STRICT_SQL))
def parse_strict_vertices(spark, sf):
    df = parse.parse_strict(comps(spark, sf))
    flat = (
        "flatten(transform(filter(parsed.rooms, r -> size(r.points) > 0), (r, k) -> zip_with(r.points, r.idx,"
        " (p, i) -> named_struct('room', k, 'token_index', i, 'x', p.x, 'y', p.y))))"
    )
    return df.select("plan_id", "gen_idx", F.expr(f"inline_outer({flat})")).filter("room is not null")


_VALS = "list_transform(regexp_extract_all(b, '<[XY]:([0-9]+)>', 1), lambda v: least(255, v::INTEGER))"
_ANSWER_SQL = {
    **COMP_SQL,
    "seg": "SELECT plan_id, variant, regexp_extract(array_to_string(l[list_position(l, '<OUTPUT>') + 1:], ' '), '^(.*?)(?:<END_OUTPUT>|<EOS>|$)', 1) AS t FROM comp",
    "blk": "SELECT plan_id, variant, unnest(f) AS b, unnest(range(len(f))) AS k FROM (SELECT *, regexp_extract_all(t, '<FRONT_DOOR>.*?(?:<END_DOOR>|$)|<ROOM>.*?(?:<END_ROOM>|$)|<DOOR>.*?(?:<END_DOOR>|$)') AS f FROM seg)",
    "rb": "SELECT plan_id, variant, (row_number() OVER (PARTITION BY plan_id, variant ORDER BY k) - 1)::INTEGER AS pos, b FROM blk WHERE b LIKE '<ROOM>%<END_ROOM>'",
    "db": f"SELECT plan_id, variant, k, {_VALS} AS v FROM blk WHERE b LIKE '<DOOR>%<END_DOOR>' AND len({_VALS}) >= 4",
    "fb": f"SELECT DISTINCT ON (plan_id, variant) plan_id, variant, b, {_VALS} AS v FROM blk WHERE b LIKE '<FRONT_DOOR>%<END_DOOR>' ORDER BY plan_id, variant, k DESC",
    "ok": "SELECT DISTINCT plan_id, variant FROM rb",
}


@query("parse_answer", s.with_ctes(
    f"""SELECT plan_id, variant AS gen_idx, 'room' AS kind, pos, coalesce(list_last(regexp_extract_all(b, '<TYPE:([^>]+)>', 1)), 'unknown') || ':' || array_to_string({_VALS}, ',') AS val FROM rb
        UNION ALL SELECT plan_id, variant, 'edge', (row_number() OVER (PARTITION BY plan_id, variant ORDER BY k) - 1)::INTEGER, '0-0:' || array_to_string(v[1:4], ',') FROM db SEMI JOIN ok USING (plan_id, variant)
        UNION ALL SELECT plan_id, variant, 'front', 0, array_to_string(v[1:4], ',') FROM fb SEMI JOIN ok USING (plan_id, variant) WHERE b NOT LIKE '%<NO_DOOR>%' AND len(v) >= 4
        UNION ALL SELECT plan_id, variant, 'failed', 0, '' FROM comp ANTI JOIN ok USING (plan_id, variant)""", _ANSWER_SQL))
def parse_answer(spark, sf):
    df = parse.parse_answer(comps(spark, sf))
    text = lambda v: f"array_join(transform({v}, q -> cast(q as string)), ',')"
    door = lambda d: text(f"array({d}.x, {d}.y, {d}.w, {d}.h)")
    return df.select("plan_id", "gen_idx", F.expr(
        "inline_outer(if(plan is null, array(named_struct('kind', 'failed', 'pos', 0, 'val', '')), concat("
        f"transform(plan.rooms, r -> named_struct('kind', 'room', 'pos', r.rid, 'val', concat(r.type, ':', {text('r.coords')}))),"
        f"transform(plan.edges, (e, i) -> named_struct('kind', 'edge', 'pos', i, 'val', concat(cast(e.pair[0] as string), '-', cast(e.pair[1] as string), ':', {door('e.door[0]')}))),"
        f"if(plan.front_door is null, slice(array(named_struct('kind', 'front', 'pos', 0, 'val', '')), 1, 0), array(named_struct('kind', 'front', 'pos', 0, 'val', {door('plan.front_door')}))))))"))


_COND_SQL = {
    **_DROP0,
    "seg": "SELECT plan_id, variant, regexp_extract(t, '<INPUT>(.*?)(?:<END_INPUT>|$)', 1) AS t FROM cond",
    "blk": """SELECT plan_id, variant, unnest(f) AS b, unnest(range(len(f))) AS k FROM (SELECT *, regexp_extract_all(t,
        '<ROOM_SUMMARY>.*?(?:<END_ROOM_SUMMARY>|$)|<FRONT_DOOR>.*?(?:<END_DOOR>|$)|<ROOM>.*?(?:<END_ROOM>|$)|<EDGE>.*?(?:<END_EDGE>|$)|<SP>.*?(?:<END_SP>|$)') AS f FROM seg)""",
    "rb": "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY k) - 1 AS pos FROM blk WHERE b LIKE '<ROOM>%'",
    "eb": "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY k) - 1 AS pos FROM blk WHERE b LIKE '<EDGE>%'",
    "sb": "SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY k) - 1 AS pos FROM blk WHERE b LIKE '<SP>%'",
}


@query("parse_condition", s.with_ctes(digest_sql(
    f"""SELECT plan_id, 'room' AS kind, pos::INTEGER AS pos, coalesce(nullif(regexp_extract(b, '<RID:([0-9]+)>', 1), ''), pos::VARCHAR) || ':' ||
          coalesce(nullif(regexp_extract(b, '<TYPE:([^>]+)>', 1), ''), 'unknown') || ':' || array_to_string({_VALS}, ',') AS val FROM rb
        UNION ALL SELECT plan_id, 'edge', pos::INTEGER, coalesce(list_last(regexp_extract_all(b, '<RID:([0-9]+)>', 1)), '-') || ':' ||
          CASE WHEN len({_VALS}) >= 4 THEN array_to_string({_VALS}, ',') ELSE '' END FROM eb
        UNION ALL SELECT plan_id, 'rel', pos::INTEGER, array_to_string(regexp_extract_all(b, '<RID:([0-9]+)>', 1), '-') || ':' || regexp_extract(b, '<REL:([^>]+)>', 1) FROM sb
        UNION ALL SELECT plan_id, 'front', 0, array_to_string({_VALS}, ',') FROM blk WHERE b LIKE '<FRONT_DOOR>%' AND len({_VALS}) >= 4"""), _COND_SQL))
def parse_condition(spark, sf):
    df = tk.condition_tokens(a.coord_noise(a.drop_state(one(spark, sf)))).select("plan_id", "condition")
    df = parse.parse_condition(df, "condition")
    text = lambda v: f"array_join(transform({v}, q -> cast(q as string)), ',')"
    door = lambda d: text(f"array({d}.x, {d}.y, {d}.w, {d}.h)")
    return digests(df.select("plan_id", F.expr(
        f"inline_outer(concat(transform(plan.rooms, (r, i) -> named_struct('kind', 'room', 'pos', i, 'val', concat(cast(r.rid as string), ':', r.type, ':', {text('r.coords')}))),"
        f" transform(plan.edges, (e, i) -> named_struct('kind', 'edge', 'pos', i, 'val', concat(coalesce(cast(e.rid as string), '-'), ':', if(size(e.doors) = 0, '', {door('e.doors[0]')})))),"
        f" transform(plan.spatial, (r, i) -> named_struct('kind', 'rel', 'pos', i, 'val', concat(cast(r.rid_a as string), '-', cast(r.rid_b as string), ':', r.direction))),"
        f" if(plan.front_door is null, slice(array(named_struct('kind', 'front', 'pos', 0, 'val', '')), 1, 0), array(named_struct('kind', 'front', 'pos', 0, 'val', {door('plan.front_door')})))))")).filter("kind is not null"))


@query("doors_as_edges", s.with_ctes(
    """SELECT plan_id, variant AS gen_idx, 0 AS a, 0 AS b, v[1] AS x, v[2] AS y, v[3] AS w, v[4] AS h FROM db SEMI JOIN ok USING (plan_id, variant)""", _ANSWER_SQL))
def doors_as_edges(spark, sf):
    df = parse.parse_answer(comps(spark, sf))
    return df.select("plan_id", "gen_idx", F.expr(
        "inline_outer(transform(plan.edges, e -> named_struct('a', e.pair[0], 'b', e.pair[1], 'x', e.door[0].x, 'y', e.door[0].y, 'w', e.door[0].w, 'h', e.door[0].h)))")).filter("a is not null")


@query("token_values", s.with_ctes(
    """SELECT w AS token, count(*) AS n, CASE WHEN w LIKE '<X:%' THEN w[4:-2]::INTEGER END AS x, CASE WHEN w LIKE '<Y:%' THEN w[4:-2]::INTEGER END AS y,
          CASE WHEN w LIKE '<RID:%' THEN w[6:-2]::INTEGER END AS rid, CASE WHEN w LIKE '<TYPE:%' THEN w[7:-2] END AS type, CASE WHEN w LIKE '<REL:%' THEN w[6:-2] END AS rel
       FROM (SELECT unnest(string_split(t, ' ')) AS w FROM cond) GROUP BY ALL""", _DROP0))
def token_values(spark, sf):
    df = tk.condition_tokens(a.coord_noise(a.drop_state(one(spark, sf))))
    words = df.select(F.explode_outer("condition").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return words.select(
        "token", "n", F.expr(t.number_value("token", "X")).alias("x"), F.expr(t.number_value("token", "Y")).alias("y"),
        F.expr(t.number_value("token", "RID")).alias("rid"), F.expr(t.word_value("token", "TYPE")).alias("type"),
        F.expr(t.word_value("token", "REL")).alias("rel"),
    )


@query("cut_at_stop_token", s.with_ctes(
    """SELECT plan_id, variant AS gen_idx, array_to_string(l[1:list_position(l, '<END_OUTPUT>') - 1], ' ') AS tokens FROM comp""", COMP_SQL))
def cut_at_stop_token(spark, sf):
    df = parse.cut_at_stop(comps(spark, sf), "tokens", ["<END_OUTPUT>", "<EOS>", "<|im_end|>"])
    return df.select("plan_id", "gen_idx", F.array_join("tokens", " ").alias("tokens"))


@query("run_counters", s.with_ctes(
    """SELECT variant AS gen_idx, count(*) AS n_outputs, count(o.plan_id) AS n_parsed, count(*) - count(o.plan_id) AS n_failed
       FROM comp c LEFT JOIN ok o USING (plan_id, variant) GROUP BY ALL""", _ANSWER_SQL))
def run_counters(spark, sf):
    return parse.run_counters(parse.parse_answer(comps(spark, sf)), ["gen_idx"])
