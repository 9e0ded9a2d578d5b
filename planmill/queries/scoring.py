"""Score, matching and advantage queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from planmill.constants import ADVANTAGE_EPS, DOOR_REACH, OUTLINE
from planmill.functions import geometry as g
from planmill.operators import advantage, parse, score
from planmill.operators.rows import keep_rows
from planmill.operators.shapes import ring_distance
from planmill.queries import sql as s
from planmill.queries.augmentation import plans
from planmill.queries.parsing import STRICT_SQL
from planmill.queries.registry import query
from planmill.session import written
from planmill.sources.completions import completions

ALL = score.RewardConfig()


def only(*names):
    return replace(ALL, rewards={n: replace(r, enabled=n in names) for n, r in ALL.rewards.items()})


def unmarked(cfg):
    """The same scores without error indices, for queries that return none."""
    return replace(cfg, rewards={n: replace(r, credit=False) for n, r in cfg.rewards.items()})


def parsed(spark, sf):
    return parse.parse_strict(completions(score.metadata(plans(spark, sf)), keep=("meta",)), length="n_tokens")


def ints(c, alias):
    return F.expr(f"array_join(transform({c}, i -> cast(i as string)), ',')").alias(alias)


R = STRICT_SQL
GATE = {
    **R,
    "gate": "SELECT plan_id, variant, level = 3 AND n_rooms >= 2 AS ok, n_rooms FROM pres",
    "gout": f"""SELECT plan_id, variant, rid AS src, type, coords, {s.mean(s.xs('coords'))} AS cx, {s.mean(s.ys('coords'))} AS cy,
          (k - 1)::INTEGER AS out FROM roomG JOIN canon USING (plan_id, variant, rid) JOIN gate USING (plan_id, variant) WHERE ok AND type <> '{OUTLINE}'""",
    "want": f"SELECT plan_id, rid, type, cx, cy FROM centre",
    "wn": "SELECT plan_id, count(*) AS n FROM want GROUP BY 1",
    # scores
    "s_total": "SELECT g.plan_id, g.variant, CASE WHEN ok AND n_rooms - 1 = n THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM gate g JOIN wn USING (plan_id)",
    "wt": "SELECT plan_id, type, count(*) AS e FROM want GROUP BY ALL",
    "ot": "SELECT plan_id, variant, type, count(*) AS a FROM gout GROUP BY ALL",
    "acc": """SELECT g.plan_id, g.variant, wt.type, greatest(0::DOUBLE, 1 - abs(coalesce(a, 0) - e)::DOUBLE / greatest(e, 1)::DOUBLE) AS v
        FROM gate g JOIN wt USING (plan_id) LEFT JOIN ot ON ot.plan_id = g.plan_id AND ot.variant = g.variant AND ot.type = wt.type WHERE ok
        UNION ALL SELECT ot.plan_id, ot.variant, ot.type, 0 FROM ot ANTI JOIN wt ON wt.plan_id = ot.plan_id AND wt.type = ot.type""",
    "s_type": "SELECT plan_id, variant, coalesce(avg(v), 0) AS v FROM gate LEFT JOIN acc USING (plan_id, variant) GROUP BY ALL",
    "gv": "SELECT plan_id, variant, rid, unnest(range(len(coords) // 2)) AS i, len(coords) // 2 AS n, unnest(list_transform(range(len(coords) // 2), lambda k: coords[2 * k + 1])) AS x, unnest(list_transform(range(len(coords) // 2), lambda k: coords[2 * k + 2])) AS y FROM roomG JOIN gate USING (plan_id, variant) WHERE ok",
    "ang": """SELECT c.plan_id, c.variant, ((p.x - c.x) * (n.x - c.x) + (p.y - c.y) * (n.y - c.y))::DOUBLE AS dot, ((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS l1, ((n.x - c.x) ** 2 + (n.y - c.y) ** 2) AS l2
        FROM gv c JOIN gv p ON p.plan_id = c.plan_id AND p.variant = c.variant AND p.rid = c.rid AND p.i = (c.i + c.n - 1) % c.n
        JOIN gv n ON n.plan_id = c.plan_id AND n.variant = c.variant AND n.rid = c.rid AND n.i = (c.i + 1) % c.n""",
    "s_orth": "SELECT plan_id, variant, coalesce(avg((abs(dot / (sqrt(l1) * sqrt(l2))) <= 0.001)::INTEGER) FILTER (l1 > 0 AND l2 > 0), 0)::DOUBLE AS v FROM gate LEFT JOIN ang USING (plan_id, variant) GROUP BY ALL",
    "rpart": f"""SELECT plan_id, variant, out, coords[1] AS xa, coords[5] AS xb, CASE WHEN len(coords) = 12 THEN coords[8] ELSE coords[2] END AS ya, coords[4] AS yb FROM gout
        UNION ALL SELECT plan_id, variant, out, coords[1], coords[9], coords[2], coords[8] FROM gout WHERE len(coords) = 12""",
    "com": "SELECT a.plan_id, a.variant, sum(greatest(0, least(a.xb, b.xb) - greatest(a.xa, b.xa)) * greatest(0, least(a.yb, b.yb) - greatest(a.ya, b.ya)))::DOUBLE AS c FROM rpart a JOIN rpart b ON a.plan_id = b.plan_id AND a.variant = b.variant AND a.out < b.out GROUP BY ALL",
    "tot": "SELECT plan_id, variant, sum((xb - xa) * (yb - ya))::DOUBLE AS t, count(DISTINCT out) AS n FROM rpart GROUP BY ALL",
    "s_over": "SELECT plan_id, variant, CASE WHEN NOT ok THEN 0 WHEN n < 2 THEN 1 ELSE 1 - least(coalesce(c, 0) / t, 1) END::DOUBLE AS v FROM gate LEFT JOIN tot USING (plan_id, variant) LEFT JOIN com USING (plan_id, variant)",
    # cheapest assignment within a type, by enumeration
    "cin2": "SELECT w.plan_id, g.variant, w.type, w.rid, w.cx, w.cy, row_number() OVER (PARTITION BY w.plan_id, g.variant, w.type ORDER BY w.rid) - 1 AS i, e, a FROM want w JOIN wt USING (plan_id, type) JOIN ot g ON g.plan_id = w.plan_id AND g.type = w.type",
    "cost": "SELECT c.plan_id, c.variant, c.type, c.i, c.rid, o.out, c.e, c.a, sqrt((c.cx - o.cx) ** 2 + (c.cy - o.cy) ** 2) AS d FROM cin2 c JOIN gout o ON o.plan_id = c.plan_id AND o.variant = c.variant AND o.type = c.type",
    "slot": "SELECT plan_id, variant, type, i, rid, out, d FROM cost UNION ALL SELECT plan_id, variant, type, i, rid, -1, 0 FROM cin2 WHERE e > a",
    "ways": """SELECT plan_id, variant, type, 0::BIGINT AS i, [out] AS p, d AS c FROM slot WHERE i = 0
        UNION ALL SELECT w.plan_id, w.variant, w.type, w.i + 1, list_append(w.p, s.out), w.c + s.d FROM ways w JOIN slot s
          ON s.plan_id = w.plan_id AND s.variant = w.variant AND s.type = w.type AND s.i = w.i + 1 WHERE s.out = -1 OR NOT list_contains(w.p, s.out)""",
    "fulls": "SELECT w.plan_id, w.variant, w.type, p, c FROM ways w JOIN (SELECT DISTINCT plan_id, variant, type, e, a FROM cin2) USING (plan_id, variant, type) WHERE w.i = e - 1 AND len(list_filter(p, lambda q: q >= 0)) = least(e, a)",
    "best": "SELECT DISTINCT ON (plan_id, variant, type) plan_id, variant, type, p, c FROM fulls ORDER BY plan_id, variant, type, round(c, 9), p",
    "mtch": "SELECT b.plan_id, b.variant, c.rid, b.p[c.i + 1] AS out FROM best b JOIN cin2 c USING (plan_id, variant, type) WHERE b.p[c.i + 1] >= 0",
    # connectivity and relations
    "gdoor": f"SELECT plan_id, variant, pos, {s.ri('x')} AS x, {s.ri('y')} AS y FROM edgeG JOIN gate USING (plan_id, variant) WHERE ok AND hd",
    "gside": "SELECT c.plan_id, c.variant, o.out, c.x AS ax, c.y AS ay, n.x - c.x AS dx, n.y - c.y AS dy FROM gv c JOIN gv n ON n.plan_id = c.plan_id AND n.variant = c.variant AND n.rid = c.rid AND n.i = (c.i + 1) % c.n JOIN gout o ON o.plan_id = c.plan_id AND o.variant = c.variant AND o.src = c.rid",
    "near": f"""SELECT plan_id, variant, pos, out FROM (SELECT d.plan_id, d.variant, d.pos, e.out, e.ax, e.ay, e.dx, e.dy, d.x, d.y,
          CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0::DOUBLE, least(1::DOUBLE, ((d.x - ax) * dx + (d.y - ay) * dy)::DOUBLE / (dx * dx + dy * dy)::DOUBLE)) END AS t
        FROM gdoor d JOIN gside e ON e.plan_id = d.plan_id AND e.variant = d.variant) GROUP BY ALL HAVING min(sqrt((x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2)) <= {DOOR_REACH}""",
    "linked": "SELECT DISTINCT p.plan_id, p.variant, p.out AS oa, q.out AS ob FROM near p JOIN near q ON p.plan_id = q.plan_id AND p.variant = q.variant AND p.pos = q.pos",
    "ecnt": "SELECT plan_id, count(*) AS n, count(*) FILTER (hd) AS nd FROM edge0 GROUP BY 1",
    "eok": "SELECT e.plan_id, a.variant, count(*) AS k FROM edge0 e JOIN mtch a ON a.plan_id = e.plan_id AND a.rid = e.a JOIN mtch b ON b.plan_id = e.plan_id AND b.variant = a.variant AND b.rid = e.b JOIN linked l ON l.plan_id = e.plan_id AND l.variant = a.variant AND l.oa = a.out AND l.ob = b.out WHERE hd GROUP BY ALL",
    "mcnt": "SELECT plan_id, variant, count(*) AS m FROM mtch GROUP BY ALL",
    "s_conn": "SELECT g.plan_id, g.variant, CASE WHEN NOT ok THEN 0 WHEN n IS NULL THEN 1 WHEN m IS NULL THEN 0 WHEN nd = 0 THEN 1 ELSE coalesce(k, 0)::DOUBLE / nd END::DOUBLE AS v FROM gate g LEFT JOIN ecnt USING (plan_id) LEFT JOIN mcnt USING (plan_id, variant) LEFT JOIN eok USING (plan_id, variant)",
    "scnt": "SELECT plan_id, count(*) AS n FROM rel0 GROUP BY 1",
    "sok": f"SELECT r.plan_id, a.variant, count(*) AS k FROM rel0 r JOIN mtch a ON a.plan_id = r.plan_id AND a.rid = r.a JOIN mtch b ON b.plan_id = r.plan_id AND b.variant = a.variant AND b.rid = r.b JOIN gout oa ON oa.plan_id = r.plan_id AND oa.variant = a.variant AND oa.out = a.out JOIN gout ob ON ob.plan_id = r.plan_id AND ob.variant = a.variant AND ob.out = b.out WHERE {s.scored('(ob.cx - oa.cx)', '(ob.cy - oa.cy)')} = r.direction GROUP BY ALL",
    "s_spat": "SELECT g.plan_id, g.variant, CASE WHEN NOT ok THEN 0 WHEN n IS NULL THEN 1 WHEN m IS NULL THEN 0 ELSE coalesce(k, 0)::DOUBLE / n END::DOUBLE AS v FROM gate g LEFT JOIN scnt USING (plan_id) LEFT JOIN mcnt USING (plan_id, variant) LEFT JOIN sok USING (plan_id, variant)",
    "rew": """SELECT g.plan_id, g.variant, ok::INTEGER::DOUBLE AS r_format, a.v AS r_count_total, b.v AS r_count_type, c.v AS r_orthogonality, d.v AS r_no_overlap, e.v AS r_connectivity, f.v AS r_spatial
        FROM gate g JOIN s_total a USING (plan_id, variant) JOIN s_type b USING (plan_id, variant) JOIN s_orth c USING (plan_id, variant) JOIN s_over d USING (plan_id, variant) JOIN s_conn e USING (plan_id, variant) JOIN s_spat f USING (plan_id, variant)""",
}


def with_recursive(body, extra=None):
    return s.with_ctes(body, {**GATE, **(extra or {})}).replace("WITH ", "WITH RECURSIVE ", 1).replace("ways AS MATERIALIZED", "ways AS")


def single(name, table, column):
    sql = with_recursive(f"SELECT plan_id, variant AS gen_idx, round(v, 6) AS {column} FROM {table}")

    @query(f"score_{name}", sql)
    def run(spark, sf):
        return score.score(parsed(spark, sf), unmarked(only("format", name))).select(
            "plan_id", "gen_idx", F.round(f"r_{name}", 6).alias(column)
        )


single("count_total", "s_total", "r_count_total")
single("count_type", "s_type", "r_count_type")
single("orthogonality", "s_orth", "r_orthogonality")
single("no_overlap", "s_over", "r_no_overlap")
single("connectivity", "s_conn", "r_connectivity")
single("spatial", "s_spat", "r_spatial")


@query("score_format", with_recursive(
    """SELECT plan_id, variant AS gen_idx, (level = 3 AND n_rooms >= 2)::INTEGER::DOUBLE AS r_format,
          CASE WHEN level < 3 THEN errors WHEN n_rooms < 2 THEN (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT unnest(range(st::BIGINT, (st + len(b))::BIGINT)) AS i FROM crt WHERE crt.plan_id = p.plan_id AND crt.variant = p.variant)) ELSE '' END AS e_format
       FROM pres p"""))
def score_format(spark, sf):
    return score.score(parsed(spark, sf), only("format")).select("plan_id", "gen_idx", "r_format", ints("e_format", "e_format"))


_MARKS = {
    "gvo": "SELECT plan_id, variant, out, unnest(range(len(coords) // 2))::INTEGER AS i, unnest(list_transform(range(len(coords) // 2), lambda k: coords[2 * k + 1])) AS x, unnest(list_transform(range(len(coords) // 2), lambda k: coords[2 * k + 2])) AS y, len(coords) // 2 AS n FROM gout",
    "geo": "SELECT c.plan_id, c.variant, c.out, least(c.x, n.x) AS xa, greatest(c.x, n.x) AS xb, least(c.y, n.y) AS ya, greatest(c.y, n.y) AS yb FROM gvo c JOIN gvo n ON n.plan_id = c.plan_id AND n.variant = c.variant AND n.out = c.out AND n.i = (c.i + 1) % c.n",
    "crect": """SELECT a.plan_id, a.variant, a.out AS oa, b.out AS ob, greatest(a.xa, b.xa) AS xa, least(a.xb, b.xb) AS xb, greatest(a.ya, b.ya) AS ya, least(a.yb, b.yb) AS yb
        FROM rpart a JOIN rpart b ON a.plan_id = b.plan_id AND a.variant = b.variant AND a.out < b.out WHERE least(a.xb, b.xb) > greatest(a.xa, b.xa) AND least(a.yb, b.yb) > greatest(a.ya, b.ya)""",
    "cpair": "SELECT DISTINCT plan_id, variant, oa, ob FROM crect",
    "cand": """SELECT p.*, v.x, v.y FROM cpair p JOIN gvo v ON v.plan_id = p.plan_id AND v.variant = p.variant AND (v.out = p.oa OR v.out = p.ob)
        UNION SELECT p.*, CASE WHEN a.xa = a.xb THEN a.xa ELSE b.xa END, CASE WHEN a.xa = a.xb THEN b.ya ELSE a.ya END FROM cpair p
          JOIN geo a ON a.plan_id = p.plan_id AND a.variant = p.variant AND a.out = p.oa JOIN geo b ON b.plan_id = p.plan_id AND b.variant = p.variant AND b.out = p.ob
          WHERE (a.xa = a.xb AND b.ya = b.yb AND a.xa BETWEEN b.xa AND b.xb AND b.ya BETWEEN a.ya AND a.yb) OR (a.ya = a.yb AND b.xa = b.xb AND b.xa BETWEEN a.xa AND a.xb AND a.ya BETWEEN b.ya AND b.yb)""",
    "cpnt": "SELECT DISTINCT c.* FROM cand c JOIN crect r USING (plan_id, variant, oa, ob) WHERE c.x BETWEEN r.xa AND r.xb AND c.y BETWEEN r.ya AND r.yb",
    "cnear": """SELECT c.plan_id, c.variant, v.out, arg_min(v.i, ((v.x - c.x) ** 2 + (v.y - c.y) ** 2)::BIGINT * 1000 + v.i) AS i FROM cpnt c
        JOIN gvo v ON v.plan_id = c.plan_id AND v.variant = c.variant AND (v.out = c.oa OR v.out = c.ob) GROUP BY c.plan_id, c.variant, c.oa, c.ob, c.x, c.y, v.out""",
}


@query("overlap_marks", with_recursive(
    "SELECT plan_id, variant AS gen_idx, out, string_agg(i, ',' ORDER BY i) AS vertices FROM (SELECT DISTINCT * FROM cnear) GROUP BY ALL", _MARKS))
def overlap_marks(spark, sf):
    """Marked vertices of overlapping rooms, by the place of the room in the answer and of the vertex in the room."""
    df = score.score(parsed(spark, sf), only("format", "no_overlap"))
    out = df.select("plan_id", "gen_idx", "e_no_overlap", F.posexplode(F.expr(f"filter(parsed.rooms, r -> r.type <> '{OUTLINE}')")).alias("out", "r"))
    marked = out.withColumn("m", F.expr("filter(transform(r.idx, (t, i) -> if(array_contains(e_no_overlap, t), i, -1)), i -> i >= 0)"))
    return keep_rows(marked, "size(m) > 0").select("plan_id", "gen_idx", "out", F.expr("array_join(transform(m, i -> cast(i as string)), ',')").alias("vertices"))


@query("room_matching", with_recursive("SELECT plan_id, variant AS gen_idx, rid, out FROM mtch"))
def room_matching(spark, sf):
    df = parsed(spark, sf).withColumn("_gate", F.expr(f"{score.format_score()} = 1D"))
    return score.with_match(df).select("plan_id", "gen_idx", F.expr("inline_outer(match)")).filter("rid is not null")


@query("door_room_distance", s.with_ctes(
    """SELECT plan_id, pos, rid, round(min(sqrt((x - (ax + t * dx)) ** 2 + (y - (ay + t * dy)) ** 2)), 6) AS dist FROM (
         SELECT e.plan_id, e.pos, r.rid, e.x, e.y, r.ax, r.ay, r.dx, r.dy,
           greatest(0::DOUBLE, least(1::DOUBLE, ((e.x - ax) * dx + (e.y - ay) * dy) / (dx * dx + dy * dy)::DOUBLE)) AS t
         FROM edge0 e JOIN (SELECT plan_id, rid, coords[2*k+1] AS ax, coords[2*k+2] AS ay, coords[(2*k+2) % len(coords) + 1] - coords[2*k+1] AS dx, coords[(2*k+3) % len(coords) + 1] - coords[2*k+2] AS dy
           FROM (SELECT plan_id, rid, coords, unnest(range(len(coords) // 2)) AS k FROM room0)) r ON r.plan_id = e.plan_id AND r.rid IN (e.a, e.b) WHERE hd)
       GROUP BY ALL"""))
def door_room_distance(spark, sf):
    # Outer, as for another one the optimizer asks for lists that are not empty before it makes them, and so makes them twice.
    df = plans(spark, sf).select("plan_id", "rooms", F.posexplode_outer("edges").alias("pos", "e")).filter("size(e.door) > 0")
    df = df.select("plan_id", "pos", F.expr("e.door[0]").alias("d"), F.explode_outer(F.expr("filter(rooms, r -> array_contains(e.pair, r.rid))")).alias("r"))
    dist = ring_distance(F.col("d.x"), F.col("d.y"), F.col("r.coords"))
    return df.filter("r is not null").select("plan_id", "pos", "r.rid", F.round(dist, 6).alias("dist"))


COLS = [f"r_{n}" for n in score.REWARDS]


@query("score_all", with_recursive(
    f"SELECT plan_id, variant AS gen_idx, {', '.join(f'round({c}, 6) AS {c}' for c in COLS)} FROM rew"))
def score_all(spark, sf):
    df = score.score(parsed(spark, sf), unmarked(ALL))
    return df.select("plan_id", "gen_idx", *[F.round(c, 6).alias(c) for c in COLS])


@query("nested_score_metadata", s.with_ctes(
    f"""SELECT plan_id, n AS total_rooms, string_agg(type || '=' || c, ',' ORDER BY type) AS type_counts, coalesce(ne, 0)::INTEGER AS n_edges, coalesce(ns, 0)::INTEGER AS n_spatial
        FROM (SELECT plan_id, type, count(*) AS c FROM box GROUP BY ALL) JOIN outl USING (plan_id)
        LEFT JOIN (SELECT plan_id, count(*) AS ne FROM edge0 GROUP BY 1) USING (plan_id) LEFT JOIN (SELECT plan_id, count(*) AS ns FROM rel0 GROUP BY 1) USING (plan_id) GROUP BY ALL"""))
def nested_score_metadata(spark, sf):
    return score.metadata(plans(spark, sf)).select(
        "plan_id", "meta.total_rooms",
        F.expr("array_join(transform(map_entries(meta.type_counts), e -> concat(e.key, '=', cast(e.value as string))), ',')").alias("type_counts"),
        F.expr("size(meta.edges)").alias("n_edges"), F.expr("size(meta.spatial)").alias("n_spatial"),
    )


ADV = replace(ALL, rewards={**ALL.rewards, "no_overlap": replace(ALL.rewards["no_overlap"], credit=False)})


def scored(spark, sf, cfg=ADV):
    """Scores of all completions, written once and read by the statistics and by the rows."""
    df = score.score(parsed(spark, sf), cfg).withColumnRenamed("plan_id", "prompt_id")
    keep = [c for c in df.columns if c[:2] in ("r_", "e_")]
    return written(df.select("prompt_id", "gen_idx", "n_tokens", *keep))


_Z = ", ".join(
    f"coalesce((r_{n} - avg(r_{n}) OVER q) / (sqrt(var_pop(r_{n}) OVER q) + {ADVANTAGE_EPS}), 0) AS a_{n}" for n in score.REWARDS
)
_ADV_SQL = {
    "zs": f"SELECT plan_id, variant, {_Z} FROM rew WINDOW q AS (PARTITION BY plan_id)",
}


def adv_sql(body, extra):
    return s.with_ctes(body, {**GATE, **_ADV_SQL, **extra}).replace("WITH ", "WITH RECURSIVE ", 1).replace("ways AS MATERIALIZED", "ways AS")


@query("group_normalize", adv_sql(
    f"SELECT plan_id AS prompt_id, variant AS gen_idx, {', '.join(f'round(a_{n}, 4) + 0.0 AS a_{n}' for n in score.REWARDS)} FROM zs", {}))
def group_normalize(spark, sf):
    df = advantage.group_normalize(scored(spark, sf))
    return df.select("prompt_id", "gen_idx", *[F.expr(f"round(a_{n}, 4) + 0D").alias(f"a_{n}") for n in score.REWARDS])


@query("error_mask", adv_sql(
    """SELECT plan_id, variant AS gen_idx, string_agg(m, '' ORDER BY i) AS mask FROM (SELECT c.plan_id, c.variant, c.i, CASE WHEN e.i IS NULL THEN '0' ELSE '1' END AS m
       FROM ctok c LEFT JOIN cerr e USING (plan_id, variant, i)) GROUP BY ALL""", {}))
def error_mask(spark, sf):
    df = parsed(spark, sf)
    return df.select("plan_id", "gen_idx", F.expr(
        f"array_join(transform({score.error_mask('n_tokens', 'parsed.errors')}, m -> if(m = 1D, '1', '0')), '')").alias("mask"))


_W = {n: r.weight for n, r in ALL.rewards.items()}
_TOK_SQL = {
    "fmark": """SELECT plan_id, variant, i FROM cerr UNION SELECT crt.plan_id, crt.variant, unnest(range(st::BIGINT, (st + len(b))::BIGINT)) AS i
        FROM crt JOIN pres USING (plan_id, variant) WHERE level = 3 AND n_rooms < 2""",
    "tadv": f"""SELECT c.plan_id, c.variant, c.i, {' + '.join(f'{_W[n]} * a_{n}' for n in score.REWARDS if n != 'format')}
          + CASE WHEN f.i IS NULL THEN a_format ELSE -abs(a_format) * 2.0 END AS v
        FROM ctok c JOIN zs USING (plan_id, variant) LEFT JOIN fmark f USING (plan_id, variant, i)""",
}


def _stats(c):
    return [
        F.size(c).alias("n"),
        F.expr(f"round(aggregate({c}, 0D, (s, v) -> s + v) / size({c}), 4) + 0D").alias("mean_adv"),
        F.expr(f"round(array_min({c}), 4) + 0D").alias("min_adv"),
        F.expr(f"round(array_max({c}), 4) + 0D").alias("max_adv"),
    ]


_AGG = "count(*)::INTEGER AS n, round(avg(v), 4) + 0.0 AS mean_adv, round(min(v), 4) + 0.0 AS min_adv, round(max(v), 4) + 0.0 AS max_adv"


@query("token_advantages", adv_sql(
    f"SELECT plan_id AS prompt_id, variant AS gen_idx, {_AGG} FROM tadv GROUP BY ALL", _TOK_SQL))
def token_advantages(spark, sf):
    df = advantage.token_advantages(advantage.group_normalize(scored(spark, sf)), "n_tokens", ADV)
    return df.select("prompt_id", "gen_idx", *_stats("token_adv"))


@query("batch_normalize", adv_sql(
    f"""SELECT prompt_id, gen_idx, {_AGG} FROM (SELECT t.plan_id AS prompt_id, t.variant AS gen_idx, (t.v - bm) / (bs + {ADVANTAGE_EPS}) AS v
       FROM tadv t JOIN bst ON bst.b = t.plan_id::BIGINT % 64) GROUP BY ALL""",
    {**_TOK_SQL, "bst": "SELECT plan_id::BIGINT % 64 AS b, avg(m) AS bm, coalesce(stddev_samp(m), 0) AS bs FROM (SELECT plan_id, variant, avg(v) AS m FROM tadv GROUP BY ALL) GROUP BY 1"}))
def batch_normalize(spark, sf):
    df = advantage.token_advantages(advantage.group_normalize(scored(spark, sf)), "n_tokens", ADV)
    df = advantage.batch_normalize(df.withColumn("batch_id", F.expr("cast(prompt_id as bigint) % 64")))
    return df.select("prompt_id", "gen_idx", *_stats("token_adv"))


@query("token_credit", adv_sql(
    """SELECT plan_id AS prompt_id, variant AS gen_idx, round(sum(v), 4) + 0.0 AS total FROM (
         SELECT c.plan_id, c.variant, CASE WHEN f.i IS NULL THEN a_format ELSE -abs(a_format) * 1.5 END AS v
         FROM ctok c JOIN zs USING (plan_id, variant) LEFT JOIN fmark f USING (plan_id, variant, i)) GROUP BY ALL""", _TOK_SQL))
def token_credit(spark, sf):
    df = advantage.group_normalize(scored(spark, sf, only("format")))
    part = advantage.credit("a_format", score.error_mask("n_tokens", "e_format"), 1.5)
    return df.select("prompt_id", "gen_idx", F.expr(f"round(aggregate({part}, 0D, (s, v) -> s + v), 4) + 0D").alias("total"))
