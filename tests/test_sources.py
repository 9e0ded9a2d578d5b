"""Files in and out, and properties of whole-table operators."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from planmill.operators import augment as a
from planmill.operators import normalize as n
from planmill.operators import parse, quality
from planmill.operators import tokenize as tk
from planmill.sources import columnar, jsonl, raster, runs, tables, token_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    return n.row_view(tables.plans(spark, SF)).persist()


def test_jsonl_folder(spark, tmp_path):
    plan = '{"plan_id":%s,"rooms":[{"rid":0,"type":"outline","coords":[0,0,0,9,9,9,9,0]}],"edges":[{"pair":[1,2],"doors":[],"door":{"x":1,"y":2,"w":3,"h":4}}],"front_door":null,"spatial":[[1,2,"right"]]}'
    (tmp_path / "a.jsonl").write_text("\n".join([plan % 1, "", plan[:40], plan % 2]))
    (tmp_path / "single_output.jsonl").write_text((plan % 1).replace('"right"', '"left"'))
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert lines.count() == 4
    good, bad = jsonl.ingest(lines)
    assert sorted(r["plan_id"] for r in good.collect()) == ["1", "1", "2"]
    assert [r["reason"] for r in bad.collect()] == ["not_json"]
    assert good.first()["edges"][0]["door"][0]["h"] == 4.0
    assert '"left"' in jsonl.find_plan(lines, "1").first()["value"]
    first = {r["plan_id"]: r["file"] for r in jsonl.first_by_priority(lines).collect()}
    assert first == {"1": "single_output.jsonl", "2": "a.jsonl"}


def test_shards_and_splits(spark, plans, tmp_path):
    few = n.first_plans(plans, 25)
    jsonl.write_shards(few.coalesce(1), str(tmp_path / "j"), records=10)
    jsonl.write_shards(few.coalesce(1), str(tmp_path / "j"), records=10, mode="append")
    assert jsonl.read_lines(spark, str(tmp_path / "j"), "*").count() == 50
    done = quality.split_exact(few, val=0.2, test=0.2)
    columnar.write_dataset(done, str(tmp_path / "d"))
    sizes = {s: columnar.read_split(spark, str(tmp_path / "d"), s).count() for s in ("train", "validation", "test")}
    assert sizes == {"train": 15, "validation": 5, "test": 5}
    with pytest.raises(KeyError):
        columnar.read_split(spark, str(tmp_path / "d"), "dev")


def png(rows):
    """A 4-channel PNG (R, G, B, A with the code in G)."""
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for code in row for v in (9, code, 7, 255)) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "p1.png").write_bytes(png([[13, 13, 1, 1], [13, 1, 1, 17]]))
    (tmp_path / "p2.png").write_bytes(b"not an image")
    images = raster.read_images(spark, str(tmp_path))
    assert {r["plan_id"]: r["ok"] for r in images.collect()} == {"p1": True, "p2": False}
    got = sorted(tuple(r) for r in raster.runs_from_images(images).collect())
    assert got == [("p1", 0, 0, 1, 13), ("p1", 0, 2, 3, 1), ("p1", 1, 0, 0, 13), ("p1", 1, 1, 2, 1), ("p1", 1, 3, 3, 17)]
    assert raster.pixels_from_runs(raster.runs_from_images(images)).count() == 8


def test_token_files_and_runs(spark, tmp_path):
    (tmp_path / "p7.txt").write_text("<INPUT>\n  <ROOM> <RID:3> <TYPE:kitchen> <X:1> <Y:2> <END_ROOM>\n<END_INPUT>")
    (tmp_path / "p8.txt").write_text("nothing")
    got = {r["plan_id"]: r["plan"] for r in token_text.read_token_files(spark, str(tmp_path)).collect()}
    assert got["p7"]["rooms"][0]["rid"] == 3 and got["p7"]["rooms"][0]["coords"] == [1, 2]
    assert got["p8"]["rooms"] == []
    out = spark.createDataFrame([("r", "p7", 0, ["<INPUT>"], ["<OUTPUT>"], 1.23456, "s")], "run_id string, plan_id string, gen_idx int, condition array<string>, tokens array<string>, elapsed_sec double, summary string").withColumn("plan", F.lit(None).cast("struct<a:int>"))
    inputs, outputs = runs.run_tables(out)
    meta = runs.meta_json(inputs, outputs).first()["meta"]
    assert '"elapsed_sec":1.235' in meta and '"parse_success":false' in meta
    runs.write_runs(inputs, outputs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs/run_inputs")).count() == 1


def test_answer_round_trip(plans):
    df = parse.parse_answer(tk.canonical_rooms(tk.answer_tokens(plans)), "answer")
    same = df.filter(F.expr("transform(slice(plan.rooms, 2, 99), r -> r.coords) = transform(canon_rooms, r -> r.coords)"))
    assert same.count() == plans.count()


def test_flip_twice_is_identity(plans):
    one = plans.withColumn("variant", F.lit(1))
    twice = a.flip(a.flip(one))
    key = lambda d: d.select("plan_id", F.to_json("rooms").alias("r"), F.to_json("spatial").alias("s"))
    assert key(one).exceptAll(key(twice)).count() == 0


def test_dropped_rooms_leave_no_orphans(plans):
    df = a.drop_state(plans.withColumn("variant", F.lit(1)), a.SFT)
    gone = "transform(filter(zip_with(rooms, room_fate, (r, f) -> named_struct('r', r, 'f', f)), z -> z.f.gone and z.r.type <> 'outline'), z -> z.r.rid)"
    bad = f"size(filter(zip_with(edges, edge_fate, (e, f) -> named_struct('e', e, 'f', f)), z -> not z.f.gone and exists(z.e.pair, p -> array_contains({gone}, p))))"
    assert df.agg(F.sum(F.expr(bad))).first()[0] == 0


def test_band_shares(plans):
    cfg = a.replace(a.CODE_DEFAULT, p_block=0.3, p_type=0.0, p_coords=0.0)
    df = a.drop_state(a.expand_variants(plans, 5), cfg)
    gone, total = df.agg(F.sum(F.expr("size(filter(room_fate, f -> f.gone))")), F.sum(F.size("room_fate"))).first()
    assert abs(gone / total - 0.3) < 0.02


def test_hot_plan_is_set_aside(spark, tmp_path):
    li = tables.table(spark, SF, "lineitem")
    hot = li.limit(1).drop("l_orderkey").crossJoin(spark.range(3000)).drop("id").withColumn("l_orderkey", F.lit(7).cast("long"))
    hot.select(li.columns).unionByName(li).write.parquet(str(tmp_path / "lineitem.parquet"))
    tables.table(spark, SF, "orders").write.parquet(str(tmp_path / "orders.parquet"))
    over = tables.oversized_plans(spark, str(tmp_path)).collect()
    assert [r["plan_id"] for r in over] == ["7"]
    assert tables.plans(spark, str(tmp_path)).filter("plan_id = '7'").count() == 0


def test_augment_hands_on_what_it_leaves_out(plans):
    many = plans.limit(1).withColumn("plan_id", F.lit("many")).withColumn(
        "rooms", F.expr("concat(slice(rooms, 1, 1), transform(sequence(1, 16), k -> named_struct('rid', k, 'type', 'kitchen', 'coords', rooms[1].coords)))")
    )
    df = a.expand_variants(plans.limit(5).unionByName(many), 2)
    for cfg in (a.SFT, a.replace(a.SFT, shuffle_rid=False)):
        done, rejected = a.augment_with_rejected(df, cfg)
        assert {r.plan_id for r in rejected.collect()} == ({"many"} if cfg.shuffle_rid else set())
        assert done.count() + rejected.count() == df.count() == 12
