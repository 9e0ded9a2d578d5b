"""Ingest, normalisation, quality and training-row queries."""

from pyspark.sql import functions as F

from planmill.constants import OUTLINE, SYSTEM_PROMPT
from planmill.operators import normalize as n
from planmill.operators import parse, quality
from planmill.operators import tokenize as tk
from planmill.operators import augment as a
from planmill.operators import training_rows as tr
from planmill.operators.rows import keep_rows
from planmill.queries import sql as s
from planmill.queries.augmentation import digest_sql, digests, dump, dump_sql, plans
from planmill.queries.parsing import _ANSWER_SQL, comps
from planmill.queries.registry import query
from planmill.queries.token_sequences import ANSW0, COND0
from planmill.session import shared_folder
from planmill.sources import jsonl, runs, tables
from planmill.sources.completions import completions


def lines(spark, sf):
    """JSON lines of all plans; some cut off, some without relations, spread over three files."""
    base = jsonl.to_lines(tables.plans(spark, sf)).withColumn("k", F.col("plan_id").cast("long"))
    return base.select(
        F.expr(
            "case when k % 97 = 0 then left(value, length(value) - 5) when k % 89 = 0 then regexp_replace(value, ',\"spatial\":.*$', '}')"
            " when k % 83 = 0 then regexp_replace(value, '\"spatial\":.*$', '\"spatial\":[[\"a\",2,\"right\"]]}')"
            " when k % 79 = 0 then regexp_replace(value, '\"edges\":.*,\"front_door\"', '\"edges\":[{\"pair\":[null,0],\"doors\":[]}],\"front_door\"')"
            " when k % 73 = 0 then replace(value, '\"rid\":0,', '\"rid\":\"0\",')"
            " when k % 71 = 0 then regexp_replace(value, '\"coords\":.([0-9]+),', '\"coords\":[$1.0,') else value end"
        ).alias("value"),
        F.expr("case k % 3 when 0 then 'single_output.jsonl' when 1 then 'plans_0001.jsonl' else 'plans_0002.jsonl' end").alias("file"),
    )


_GOOD = "(" + " AND ".join(f"plan_id::BIGINT % {k} <> 0" for k in (97, 89, 83, 79)) + ")"


def _good_dump():
    return f"SELECT * FROM ({dump_sql('0', front=True)}) WHERE {_GOOD}"


@query("ingest_jsonl", s.with_ctes(_good_dump()))
def ingest_jsonl(spark, sf):
    good, _ = jsonl.ingest(lines(spark, sf))
    return dump(n.row_view(good).withColumn("variant", F.lit(1)), front=True)


@query("ingest_quarantine", s.with_ctes(
    """SELECT CASE WHEN ok % 97 = 0 THEN 'not_json' WHEN ok % 89 = 0 THEN 'missing_spatial' WHEN ok % 83 = 0 THEN 'bad_relation' ELSE 'bad_pair' END AS reason,
       count(*) AS n FROM outl WHERE ok % 97 = 0 OR ok % 89 = 0 OR ok % 83 = 0 OR ok % 79 = 0 GROUP BY 1"""))
def ingest_quarantine(spark, sf):
    _, bad = jsonl.ingest(lines(spark, sf))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("lenient_json_scan", """SELECT (props->>'$.k')::INTEGER AS k, event_type, count(*) AS n FROM events GROUP BY ALL""")
def lenient_json_scan(spark, sf):
    good, _ = jsonl.scan_json(tables.table(spark, sf, "events").select("event_type", "props"), "k int", "props")
    return good.groupBy("record.k", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("first_plan_by_file", s.with_ctes(
    """SELECT plan_id, ['single_output.jsonl', 'plans_0001.jsonl', 'plans_0002.jsonl'][ok % 3 + 1] AS file, 2::BIGINT + (ok % 5 = 0)::BIGINT AS n_copies FROM outl WHERE ok % 97 <> 0"""
    .replace("['single_output.jsonl', 'plans_0001.jsonl', 'plans_0002.jsonl'][ok % 3 + 1]", "CASE WHEN ok % 3 = 2 THEN 'plans_0001.jsonl' WHEN ok % 3 = 0 THEN 'single_output.jsonl' ELSE 'plans_0001.jsonl' END")))
def first_plan_by_file(spark, sf):
    # A line is made once and then stands in two or three places.
    one = lines(spark, sf).withColumn("k", F.expr("get_json_object(value, '$.plan_id')"))
    copy = "if(file = 'plans_0002.jsonl', 'plans_0001.jsonl', 'plans_0002.jsonl')"
    files = f"if(cast(k as bigint) % 5 = 0, array(file, {copy}, {copy}), array(file, {copy}))"
    both = jsonl.with_priority(keep_rows(one, "k is not null").select("value", F.explode_outer(F.expr(files)).alias("file")))
    return jsonl.first_by_priority(both).select("plan_id", "file", "n_copies")


def numbered_lines(spark, sf):
    """JSON lines of all plans, some of them broken, with the number they are ordered by."""
    base = jsonl.to_lines(tables.plans(spark, sf)).withColumn("k", F.col("plan_id").cast("long"))
    return base.select("k", F.expr(
        "case when k % 97 = 0 then left(value, length(value) - 5) when k % 89 = 0 then regexp_replace(value, ',\"spatial\":.*$', '}')"
        " when k % 31 = 0 then ' ' else value end").alias("value"))


_PLACED = {
    "lined": "SELECT ok, row_number() OVER (ORDER BY ok) - 1 AS i FROM outl",
    "placed": "SELECT ok, i // 10000 AS shard, i % 10000 + 1 AS line FROM lined",
}


@query("sharded_records", s.with_ctes(
    """SELECT 'first' AS batch, shard, count(*) AS n_records, min(ok) AS first_plan, max(ok) AS last_plan, max(line) AS last_line FROM placed GROUP BY ALL""", _PLACED))
def sharded_records(spark, sf):
    """Lines of all plans in shards of exactly 10,000, written as one batch and read back with their places."""
    folder = shared_folder(spark, "shards")
    jsonl.append_batch(jsonl.to_lines(tables.plans(spark, sf)).withColumn("k", F.col("plan_id").cast("long")), folder, "first", ["k"])
    scanned = jsonl.scan_set(spark, folder)
    k = F.get_json_object("value", "$.plan_id").cast("long")
    return jsonl.number_lines(scanned, scanned).groupBy("batch", "shard").agg(
        F.count(F.lit(1)).alias("n_records"), F.min(k).alias("first_plan"), F.max(k).alias("last_plan"), F.max("line").alias("last_line"))


@query("appended_batches", s.with_ctes(
    """SELECT batch, (first + i // 1000)::BIGINT AS shard, count(*) AS n_records, sum(ok)::BIGINT AS plans FROM (
         SELECT 'odd' AS batch, 0 AS first, ok, row_number() OVER (ORDER BY ok) - 1 AS i FROM outl WHERE ok % 2 = 1
         UNION ALL SELECT 'even', (SELECT (count(*) + 999) // 1000 FROM outl WHERE ok % 2 = 1), ok, row_number() OVER (ORDER BY ok) - 1 FROM outl WHERE ok % 2 = 0)
       GROUP BY ALL"""))
def appended_batches(spark, sf):
    """Two batches in shards of 1,000; the first is appended twice and stands there once."""
    folder = shared_folder(spark, "appended")
    rows = jsonl.to_lines(tables.plans(spark, sf)).withColumn("k", F.col("plan_id").cast("long"))
    for batch, rest in (("odd", 1), ("odd", 1), ("even", 0)):
        jsonl.append_batch(rows.filter(F.col("k") % 2 == rest), folder, batch, ["k"], records=1000)
    k = F.get_json_object("value", "$.plan_id").cast("long")
    return jsonl.scan_set(spark, folder).groupBy("batch", "shard").agg(F.count(F.lit(1)).alias("n_records"), F.sum(k).alias("plans"))


@query("quarantine_lines", s.with_ctes(
    """SELECT 'floorplans_' || lpad(shard::VARCHAR, 4, '0') || '.jsonl' AS file, line, CASE WHEN ok % 97 = 0 THEN 'not_json' ELSE 'missing_spatial' END AS reason
       FROM placed WHERE ok % 97 = 0 OR ok % 89 = 0""", _PLACED))
def quarantine_lines(spark, sf):
    """File and line of every rejected line of a shard set; blank lines count but are no records."""
    folder = shared_folder(spark, "lines")
    jsonl.append_batch(numbered_lines(spark, sf), folder, "first", ["k"])
    _, bad = jsonl.ingest_scanned(jsonl.scan_set(spark, folder))
    return bad.select("file", "line", "reason")


@query("list_plan_ids", "SELECT o_orderkey::VARCHAR AS plan_id FROM orders")
def list_plan_ids(spark, sf):
    return tables.plan_ids(spark, sf)


@query("oversized_plans", "SELECT l_orderkey::VARCHAR AS plan_id, 'too_many_rooms' AS reason, count(*) AS n_rooms FROM lineitem GROUP BY l_orderkey HAVING count(*) > 15")
def oversized_plans(spark, sf):
    return tables.oversized_plans(spark, sf)


@query("unrepresentable_plans", s.with_ctes(
    f"""SELECT coalesce(r, 'ok') AS reason, count(*) AS n FROM (SELECT p.plan_id, CASE WHEN EXISTS (SELECT 1 FROM room0 r WHERE r.plan_id = p.plan_id AND list_max(coords) + 60 > 255) THEN 'coord_out_of_range' END AS r FROM plan0 p) GROUP BY 1"""))
def unrepresentable_plans(spark, sf):
    moved = a.affine(plans(spark, sf), lambda v: f"({v} + 60D)", lambda v: f"({v} + 60D)")
    good, bad = n.split_unrepresentable(moved)
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("door_normalizer", s.with_ctes(
    """SELECT plan_id, pos, CASE WHEN pos % 3 = 2 THEN 0 WHEN hd THEN 1 ELSE 0 END AS n_doors, CASE WHEN pos % 3 = 2 OR NOT hd THEN 0 ELSE x END::DOUBLE AS x FROM edge0"""))
def door_normalizer(spark, sf):
    e = plans(spark, sf).select("plan_id", F.posexplode("edges").alias("pos", "e"))
    raw = e.withColumn("raw", F.expr("case when pos % 3 = 2 then cast(null as string) when pos % 3 = 1 and size(e.door) = 1 then to_json(e.door[0]) else to_json(e.door) end"))
    got = raw.withColumn("door", F.expr(jsonl.door_list("raw")))
    return got.select("plan_id", "pos", F.size("door").alias("n_doors"), F.expr("cast(coalesce(get(door, 0).x, 0) as double)").alias("x"))


@query("nested_row_views", s.with_ctes(digest_sql(dump_sql("0", front=True))))
def nested_row_views(spark, sf):
    df = n.row_view(n.row_view(n.columnar_view(tables.plans(spark, sf))))
    return digests(dump(df.withColumn("variant", F.lit(1)), front=True))


@query("nested_unify_rows", s.with_ctes(digest_sql(dump_sql("0"))))
def nested_unify_rows(spark, sf):
    raw = plans(spark, sf).withColumn("edges", F.expr("transform(edges, e -> named_struct('pair', e.pair, 'doors', e.door))")).withColumn(
        "spatial", F.expr("transform(spatial, s -> array(cast(s.rid_a as string), cast(s.rid_b as string), s.direction))"))
    return digests(dump(n.unify_rows(n.unify_rows(raw)).withColumn("variant", F.lit(1))))


@query("merge_room_types", """SELECT l_orderkey AS k, l_linenumber AS line, type, count(*) AS n FROM (SELECT *, ['livingroom', 'bedroom', 'kitchen', 'bathroom', 'livingroom', 'bedroom', 'studyroom', 'bedroom', 'bedroom', 'balcony', 'entrance', 'storage', 'storage'][l_partkey % 18 + 1] AS type FROM lineitem WHERE l_partkey % 18 < 13) GROUP BY ALL""")
def merge_room_types(spark, sf):
    items = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 18).cast("int").alias("code"))
    return n.merge_types(items).groupBy("k", "line", "type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_plan_ids", "SELECT l_orderkey::VARCHAR AS plan_id, count(*) AS n_rooms FROM lineitem WHERE l_orderkey IN (SELECT doc_id FROM documents) GROUP BY l_orderkey")
def filter_plan_ids(spark, sf):
    wanted = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("plan_id"))
    return n.keep_plans(tables.plan_sizes(spark, sf), wanted).select("plan_id", "n_rooms")


@query("first_n_plans", "SELECT l_orderkey::VARCHAR AS plan_id, count(*) AS n_rooms FROM lineitem GROUP BY l_orderkey ORDER BY l_orderkey LIMIT 100")
def first_n_plans(spark, sf):
    return n.first_plans(tables.plan_sizes(spark, sf), 100).select("plan_id", "n_rooms")


_SPLITU = s.u("split", variant="0")


@query("split_by_hash", s.with_ctes(f"SELECT plan_id, CASE WHEN d < 0.005 THEN 'test' WHEN d < 0.006 THEN 'validation' ELSE 'train' END AS split FROM (SELECT plan_id, {_SPLITU} AS d FROM (SELECT o_orderkey::VARCHAR AS plan_id FROM orders))"))
def split_by_hash(spark, sf):
    return quality.split_by_hash(tables.plan_ids(spark, sf))


@query("split_exact", f"""SELECT plan_id, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil((n - nt) * (0.001 / (1 - 0.005)) - 1e-9) THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT plan_id, row_number() OVER (ORDER BY {_SPLITU}, plan_id) AS r, count(*) OVER () AS n, ceil(count(*) OVER () * 0.005 - 1e-9) AS nt FROM (SELECT o_orderkey::VARCHAR AS plan_id FROM orders))""")
def split_exact(spark, sf):
    return quality.split_exact(tables.plan_ids(spark, sf))


@query("sample_rows", f"SELECT o_orderkey::VARCHAR AS plan_id FROM orders ORDER BY {s.u('sample', variant='0', plan='o_orderkey')}, 1 LIMIT 20")
def sample_rows(spark, sf):
    return quality.sample_rows(tables.plan_ids(spark, sf), 20)


def broken(spark, sf):
    """Parsed lines with one planted fault in some plans."""
    base = tables.plans(spark, sf).withColumn("k", F.col("plan_id").cast("long"))
    bad = base.withColumns({
        "rooms": F.expr(
            "transform(rooms, (r, i) -> named_struct('rid', if(k % 11 = 0 and i = 1, 0, r.rid), 'type', if(k % 31 = 0 and i = 1, cast(null as string), r.type),"
            " 'coords', case when k % 13 = 0 and i = 1 then slice(r.coords, 1, size(r.coords) - 1) when k % 37 = 0 and i = 1 then slice(r.coords, 1, 4) else r.coords end))"),
        "edges": F.expr("transform(edges, (e, i) -> named_struct('pair', case when k % 17 = 0 and i = 0 then array(e.pair[0], 99) when k % 29 = 0 and i = 0 then array(e.pair[0]) else e.pair end, 'door', e.door))"),
        "spatial": F.expr("transform(spatial, (t, i) -> named_struct('rid_a', t.rid_a, 'rid_b', t.rid_b, 'direction', if(k % 19 = 0 and i = 0, 'north', t.direction)))"),
    })
    text = jsonl.to_lines(bad).withColumn("k", F.col("plan_id").cast("long")).select(
        "plan_id", F.expr("concat('f', cast(k % 3 as string))").alias("file"),
        F.expr("if(k % 23 = 0, regexp_replace(value, ',\"h\":2.0}', '}'), if(k % 97 = 0, left(value, length(value) - 5), value))").alias("value"))
    return jsonl.parse_lines(text)


_VIOL = {
    "pl": "SELECT ok AS k, plan_id, 'f' || (ok % 3) AS file, n, ok % 97 = 0 AND ok % 23 <> 0 AS bad FROM outl",
    "r1": "SELECT k, plan_id, file, 1 + (k % 31 * 0) AS i, b.ell FROM pl JOIN box b USING (plan_id) WHERE b.rid = 1 AND NOT bad",
    "vio": """SELECT plan_id, file, 'not_json' AS rule, '' AS path FROM pl WHERE bad
        UNION ALL SELECT plan_id, file, 'duplicate_rid', 'rooms[1]' FROM r1 WHERE k % 11 = 0
        UNION ALL SELECT plan_id, file, 'missing_type', 'rooms[1]' FROM r1 WHERE k % 31 = 0
        UNION ALL SELECT plan_id, file, 'odd_coords', 'rooms[1]' FROM r1 WHERE k % 13 = 0
        UNION ALL SELECT plan_id, file, 'few_vertices', 'rooms[1]' FROM r1 WHERE k % 37 = 0 AND k % 13 <> 0
        UNION ALL SELECT e.plan_id, file, 'dangling_rid', 'edges[0]' FROM edge0 e JOIN pl USING (plan_id) WHERE pos = 0 AND k % 17 = 0 AND NOT bad
        UNION ALL SELECT e.plan_id, file, 'dangling_rid', 'edges[' || pos || ']' FROM edge0 e JOIN pl USING (plan_id) WHERE a = 1 AND k % 11 = 0 AND NOT bad AND NOT (pos = 0 AND k % 29 = 0 AND k % 17 <> 0)
        UNION ALL SELECT e.plan_id, file, 'pair_arity', 'edges[0]' FROM edge0 e JOIN pl USING (plan_id) WHERE pos = 0 AND k % 29 = 0 AND k % 17 <> 0 AND NOT bad
        UNION ALL SELECT r.plan_id, file, 'dangling_rid', 'spatial[' || pos || ']' FROM rel0 r JOIN pl USING (plan_id) WHERE a = 1 AND k % 11 = 0 AND NOT bad
        UNION ALL SELECT r.plan_id, file, 'unknown_direction', 'spatial[0]' FROM rel0 r JOIN pl USING (plan_id) WHERE pos = 0 AND k % 19 = 0 AND NOT bad
        UNION ALL SELECT f.plan_id, file, 'front_door_key', 'h' FROM front0 f JOIN pl USING (plan_id) WHERE k % 23 = 0""",
    "drank": "SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) AS r FROM (SELECT file, concat_ws('|', lpad(plan_id, 20, '0'), rule, path) AS k, concat_ws(' ', plan_id, rule, path) AS d FROM vio)",
}


@query("validate_records", s.with_ctes("SELECT plan_id, file, rule, path FROM vio", _VIOL))
def validate_records(spark, sf):
    return quality.violation_rows(broken(spark, sf)).select("plan_id", "file", "rule", "path")


@query("file_report", s.with_ctes(
    """SELECT file, count(*) AS n_records, count(v) AS n_error_records, coalesce(sum(v), 0)::BIGINT AS n_errors, round((count(*) - count(v))::DOUBLE / count(*) * 100, 1) AS pass_rate, any_value(details) AS details
       FROM pl LEFT JOIN (SELECT plan_id, count(*) AS v FROM vio GROUP BY 1) USING (plan_id) JOIN (SELECT file, string_agg(d, '; ' ORDER BY k) AS details FROM drank WHERE r <= 20 GROUP BY 1) USING (file) GROUP BY file""", _VIOL))
def file_report(spark, sf):
    return quality.file_report(broken(spark, sf))


_AUDIT = """SELECT plan_id, found, found AND ok % 5 <> 1 AS same_room_count, found AND ok % 5 <> 1 AND ok % 7 <> 1 AS same_types,
    found AND ok % 5 <> 1 AND ok % 11 <> 1 AS same_coords, found AND NOT (ok % 13 = 1 AND n > 1) AS same_pairs, found AND ok % 17 <> 1 AS same_front,
    found AND NOT (ok % 19 = 1 AND n > 1) AS same_spatial_count FROM (SELECT *, ok % 23 <> 0 AS found FROM outl)"""


def spoiled(spark, sf):
    """Converted plans with a planted fault in one field of some, and the lines they came from; some of these are gone."""
    good = plans(spark, sf).withColumn("k", F.col("plan_id").cast("long"))
    own = jsonl.to_lines(good).filter(F.col("plan_id").cast("long") % 23 != 0).select("value")
    door = "array(named_struct('x', 1D, 'y', 1D, 'w', 1D, 'h', 1D))"
    bad = good.withColumns({
        "rooms": F.expr(
            "transform(if(k % 5 = 1, slice(rooms, 1, size(rooms) - 1), rooms), (r, i) -> named_struct('rid', r.rid,"
            " 'type', if(k % 7 = 1 and i = 1, 'hall', r.type), 'coords', if(k % 11 = 1 and i = 0, transform(r.coords, v -> v + 1), r.coords)))"),
        "edges": F.expr("transform(edges, (e, i) -> named_struct('pair', if(k % 13 = 1 and i = 0, reverse(e.pair), e.pair), 'door', e.door))"),
        "front_door": F.expr(f"if(k % 17 = 1, if(size(front_door) = 0, {door}, slice(front_door, 1, 0)), front_door)"),
        "spatial": F.expr("if(k % 19 = 1 and size(spatial) > 0, slice(spatial, 1, size(spatial) - 1), spatial)"),
    })
    return bad.drop("k"), own


@query("roundtrip_audit", s.with_ctes(_AUDIT))
def roundtrip_audit(spark, sf):
    """Every field that was spoiled, and every id without a source, is found."""
    return quality.audit_lines(*spoiled(spark, sf))


@query("roundtrip_sample", s.with_ctes(f"SELECT * FROM ({_AUDIT}) ORDER BY {s.u('sample', variant='0')}, plan_id LIMIT 200"))
def roundtrip_sample(spark, sf):
    """The audit of a sample of 200 plans; their ids go to the source, which is not shuffled."""
    return quality.audit_lines(*spoiled(spark, sf), k=200)


_CHAT = f"'<|im_start|>system' || chr(10) || '{SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || @U || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query("chat_exchanges", f"""WITH t AS (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS reply,
       string_agg({_TURN}, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far,
       bool_or(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS has_system
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT *, role = 'user' AND coalesce(next_turn = turn + 1 AND next_role = 'assistant', false) AS answered,
       CASE WHEN has_system THEN '' ELSE '<|im_start|>system' || chr(10) || '{SYSTEM_PROMPT}' || '<|im_end|>' || chr(10) END || so_far || '<|im_start|>assistant' || chr(10) AS prefix FROM t WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN answered THEN 'answered' ELSE 'unanswered' END AS status,
       CASE WHEN answered THEN prefix || reply || '<|im_end|>' || chr(10) END AS full_chat, prefix AS prefix_chat FROM p""")
def chat_exchanges(spark, sf):
    return tr.exchanges(tables.table(spark, sf, "conversations")).select("conv_id", "turn", "status", "full_chat", "prefix_chat")


_PAIR = {**COND0, **ANSW0}


@query("chat_rendering", s.with_ctes(
    f"""SELECT plan_id, {_CHAT.replace('@U', "replace(c.t, ' ', '')")} || replace(w.t, ' ', '') || '<|im_end|>' || chr(10) AS full_chat FROM cond c JOIN answ w USING (plan_id, variant)""", _PAIR))
def chat_rendering(spark, sf):
    df = tk.answer_tokens(tk.condition_tokens(a.keep_everything(plans(spark, sf))))
    return tr.chat_rows(df).select("plan_id", "full_chat")


_WORDS = """SELECT u.conv_id, u.turn, list_transform(string_split(u.text, ' '), lambda w: len(w)::INTEGER) AS p, list_transform(string_split(r.text, ' '), lambda w: len(w)::INTEGER) AS q
    FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1 WHERE u.role = 'user' AND r.role = 'assistant'"""
_ROWS = {"wrd": _WORDS, "trow": "SELECT conv_id, turn, (p || q)[1:4096] AS ids, (list_transform(p, lambda v: -100) || q)[1:4096] AS lab FROM wrd"}


def word_rows(spark, sf):
    """Training rows whose ids are word lengths (the sub-word codec is an input of the operator)."""
    ids = lambda c: F.expr(f"transform(split({c}, ' ', -1), w -> length(w))")
    df = keep_rows(tr.exchanges(tables.table(spark, sf, "conversations")), "status = 'answered'")
    df = df.withColumn("prefix_ids", ids("asked")).withColumn("full_ids", F.concat(ids("asked"), ids("answered")))
    return tr.training_rows(df)


def joined(c, alias):
    return F.expr(f"array_join(transform({c}, v -> cast(v as string)), ',')").alias(alias)


@query("training_rows", s.with_ctes(
    "SELECT conv_id, turn, array_to_string(ids, ',') AS input_ids, array_to_string(lab, ',') AS labels, len(ids)::INTEGER AS n FROM trow", _ROWS))
def training_rows(spark, sf):
    return word_rows(spark, sf).select("conv_id", "turn", joined("input_ids", "input_ids"), joined("labels", "labels"), F.size("attention_mask").alias("n"))


@query("batch_padding", s.with_ctes(
    """SELECT conv_id, turn, array_to_string(ids || list_transform(range(m - len(ids)), lambda v: 0), ',') AS input_ids, array_to_string(lab || list_transform(range(m - len(ids)), lambda v: -100), ',') AS labels,
          len(ids)::INTEGER AS n_kept, m::INTEGER AS n_padded FROM trow JOIN (SELECT conv_id % 32 AS b, max(len(ids)) AS m FROM trow GROUP BY 1) ON b = conv_id % 32""", _ROWS))
def batch_padding(spark, sf):
    df = tr.pad_batches(word_rows(spark, sf).withColumn("batch_id", F.col("conv_id") % 32))
    return df.select("conv_id", "turn", joined("input_ids", "input_ids"), joined("labels", "labels"),
                     F.expr("aggregate(attention_mask, 0, (s, v) -> s + v)").alias("n_kept"), F.size("input_ids").alias("n_padded"))


@query("prompt_rows", s.with_ctes(
    f"""SELECT plan_id, {_CHAT.replace('@U', "replace(t, ' ', '')")} AS prompt, n AS total_rooms FROM cond JOIN outl USING (plan_id)""", COND0))
def prompt_rows(spark, sf):
    from planmill.operators.score import metadata

    df = metadata(tk.condition_tokens(a.keep_everything(plans(spark, sf)))).withColumn("answer", F.expr("cast(array() as array<string>)"))
    return tr.chat_rows(df).select("plan_id", F.col("prefix_chat").alias("prompt"), "meta.total_rooms")


@query("run_results", s.with_ctes(
    """SELECT c.plan_id, c.variant AS index, array_to_string(l, ' ') AS token_text, len(l)::INTEGER AS output_token_count, o.plan_id IS NOT NULL AS parse_success
       FROM comp c LEFT JOIN ok o USING (plan_id, variant)""", _ANSWER_SQL))
def run_results(spark, sf):
    df = parse.parse_answer(comps(spark, sf)).withColumns({
        "run_id": F.lit("r1"), "condition": F.expr("cast(array() as array<string>)"), "elapsed_sec": F.lit(0.0), "summary": F.lit("")})
    _, out = runs.run_tables(df)
    return out.select("plan_id", "index", "token_text", "output_token_count", "parse_success")


def run_outputs(spark, sf):
    """Two runs over all plans: `many` with four answers a plan, `one` with the first of them."""
    asked = tk.condition_tokens(a.keep_everything(plans(spark, sf)))
    df = parse.parse_answer(completions(asked, keep=("condition",)))
    k = F.col("plan_id").cast("long")
    df = df.withColumns({
        "elapsed_sec": (k % 997 + F.col("gen_idx")) / 1000.0, "summary": F.concat(F.lit("seed "), (k % 3).cast("string")),
        "run_id": F.explode(F.expr("if(gen_idx = 0, array('many', 'one'), array('many'))"))})
    return runs.run_tables(df)


_RUN = {
    **_ANSWER_SQL, **COND0,
    "outp": """SELECT c.plan_id, c.variant AS index, len(l)::INTEGER AS n_out, round((c.plan_id::BIGINT % 997 + c.variant) / 1000.0, 3)::DOUBLE AS secs, o.plan_id IS NOT NULL AS parsed
        FROM comp c LEFT JOIN ok o USING (plan_id, variant)""",
    "inp": "SELECT plan_id, 'seed ' || (plan_id::BIGINT % 3) AS aug, len(string_split(t, ' '))::INTEGER AS n_in, t FROM cond",
    "runout": "SELECT 'many' AS run_id, * FROM outp UNION ALL SELECT 'one', * FROM outp WHERE index = 0",
}


@query("run_inputs", s.with_ctes(
    """SELECT run_id, plan_id, aug AS augmentation, n_in AS input_token_count, md5(t) AS condition_md5, count(*) AS num_outputs
       FROM runout JOIN inp USING (plan_id) GROUP BY ALL""", _RUN))
def run_inputs(spark, sf):
    inputs, _ = run_outputs(spark, sf)
    return inputs.select("run_id", "plan_id", "augmentation", "input_token_count", F.md5("condition_text").alias("condition_md5"), "num_outputs")


@query("run_meta", s.with_ctes(
    """SELECT run_id, plan_id, '{"plan_id":"' || plan_id || '","augmentation":"' || aug || '","input_token_count":' || n_in || ',' ||
         CASE WHEN run_id = 'one' THEN any_value('"output_token_count":' || n_out || ',"elapsed_sec":' || secs || ',"parse_success":' || parsed) || '}'
         ELSE '"num_outputs":' || count(*) || ',"outputs":[' || string_agg('{"index":' || index || ',"output_token_count":' || n_out || ',"elapsed_sec":' || secs || ',"parse_success":' || parsed || '}', ',' ORDER BY index) || ']}' END AS meta
       FROM runout JOIN inp USING (plan_id) GROUP BY run_id, plan_id, aug, n_in""", _RUN))
def run_meta(spark, sf):
    """The meta record of every plan in a run: flat for one answer, a list for several."""
    return runs.meta_json(*run_outputs(spark, sf)).select("run_id", "plan_id", "meta")
