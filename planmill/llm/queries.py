"""One query per operator, over its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from planmill.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    fill_middle,
    html_text,
    language,
    line_dedup,
    near_dedup,
    piece_bpe,
    sharding,
    suffix_dedup,
    token_store,
    topk,
)
from planmill.llm.registry import query
from planmill.llm.rows import read_small_file, table
from planmill.session import shared_folder


@query("op1_token_store")
def op1_token_store(spark, sf_dir):
    vocabulary = read_small_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = shared_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, vocabulary, end_id=0, added_tokens=True)
    return token_store.read_records(spark, path)


@query("op7_bpe_codec")
def op7_bpe_codec(spark, sf_dir):
    ranks = read_small_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_jump_shards")
def op10_jump_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


LINE_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
w as (select doc_id, p as pos, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] as k
      from (select doc_id, lines, unnest(range(0, len(lines) - 2)) as p from d)),
t as (select doc_id, pos, row_number() over (partition by k order by doc_id, pos) as rn from w
      where trim(replace(k, chr(10), ''), ' ') <> ''),
c as (select distinct doc_id, pos + o as line from t, (values (0), (1), (2)) as v(o) where rn > 1),
l as (select doc_id, unnest(range(0, len(lines))) as line, unnest(lines) as s from d),
k as (select l.doc_id, l.line, l.s, c.line is not null as gone from l left join c using (doc_id, line)),
r as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by line), false) as opens from k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where gone) as bigint) as n_removed,
       cast(count(*) filter (where opens) as bigint) as n_spans,
       sha256(coalesce(string_agg(s, chr(10) order by line) filter (where not gone), '')) as kept_sha256
from r group by doc_id
union all
select doc_id, 0, 0, 0, sha256('') from documents where text is null
"""


@query("op5_line_dedup", LINE_SQL)
def op5_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_removed", "n_spans",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


_SQL_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
LEAK_SQL = rf"""
with d as (select doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[p + 1 : p + least(len(w), 10)], ' ') as k
        from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as p from b where len(w) > 0)),
lens as (select distinct n from win),
dw as (select doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') as k
       from (select doc_id, n, w, unnest(range(0, len(w) - n + 1)) as p from d, lens where len(w) >= n)),
occ as (select doc_id, item_id, p, n from dw join win using (n, k)),
hit as (select doc_id, count(*) as n_hit
        from (select distinct doc_id, p + o as at from (select doc_id, p, unnest(range(0, n)) as o from occ)) group by 1),
its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
        from (select distinct doc_id, cast(item_id as varchar) as i from occ) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""


@query("op6_decontaminate", LEAK_SQL)
def op6_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_minmax_dedup")
def op9_minmax_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).drop("content")


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


TOP_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
           from embeddings
           where embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             cast(list_sum(list_transform(range(1, len(c.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query("op2_exact_topk", TOP_SQL)
def op2_exact_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


@query("op8_html_text")
def op8_html_text(spark, sf_dir):
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return out.select(
        "page_id", "text", F.length("text").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"),
    )


@query("op11_piece_codec")
def op11_piece_codec(spark, sf_dir):
    model = read_small_file(public_tokenizers.path("piece_bpe_32k.model"))
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"), model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_fill_middle")
def op13_fill_middle(spark, sf_dir):
    examples = fill_middle.transform(table(spark, sf_dir, "documents"))
    return fill_middle.restore(examples).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = conversation_repair.damage(conversations)
    return conversation_repair.summaries(damaged, also=conversations.select("conv_id"))
