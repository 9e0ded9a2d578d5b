"""Line numbers over split files, exact shards, and batches that count once."""

import json
import random

import pytest

from planmill.sources import jsonl


@pytest.fixture
def small_splits(spark):
    """Files are read in parts of 300 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def record(k, **changes):
    plan = {"plan_id": k, "rooms": [], "edges": [], "front_door": None, "spatial": []}
    plan.update(changes)
    return json.dumps({k: v for k, v in plan.items() if v != "gone"})


def test_file_and_line_of_rejects(small_splits, tmp_path):
    rng = random.Random(8)
    want = set()
    for name in ("a.jsonl", "b.jsonl", "single_output.jsonl"):
        lines = []
        for k in range(rng.randrange(80, 120)):
            kind = rng.choice(["good", "good", "blank", "broken", "short"])
            lines.append({"good": record(k), "blank": " ", "broken": record(k)[:-9], "short": record(k, spatial="gone")}[kind])
            if kind in ("broken", "short"):
                want.add((name, k + 1, "not_json" if kind == "broken" else "missing_spatial"))
        (tmp_path / name).write_text("\n".join(lines) + "\n" * rng.randrange(2))
    scanned = jsonl.scan_lines(small_splits, str(tmp_path))
    assert scanned.select("file", "split").distinct().count() > 20
    good, bad = jsonl.ingest_folder(small_splits, str(tmp_path))
    assert {(r["file"], r["line"], r["reason"]) for r in bad.collect()} == want and bad.count() == len(want)
    assert not {"split", "row"} & set(bad.columns) and good.count() > 100


def test_first_of_equal_ids_goes_by_line(small_splits, tmp_path):
    lines = [record(k % 7, front_door={"x": 50 - k, "y": 0, "w": 1, "h": 1}) for k in range(50)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    first = jsonl.first_by_priority(jsonl.read_lines(small_splits, str(tmp_path)))
    got = {r["plan_id"]: (json.loads(r["value"])["front_door"]["x"], r["n_copies"]) for r in first.collect()}
    assert got == {str(k): (50 - k, 8 if k < 1 else 7) for k in range(7)}
    assert json.loads(jsonl.find_plan(jsonl.read_lines(small_splits, str(tmp_path)), "3").first()["value"])["front_door"]["x"] == 47


def lines_of(spark, n, start=0):
    rows = [(start + i, record(start + i)) for i in range(n)]
    random.Random(n).shuffle(rows)
    return spark.createDataFrame(rows, "k long, value string").repartition(7)


def shards_of(spark, folder):
    scanned = jsonl.scan_set(spark, folder)
    numbered = jsonl.number_lines(scanned, scanned).orderBy("shard", "line").collect()
    out = {}
    for r in numbered:
        assert r["file"] == f"floorplans_{r['shard']:04d}.jsonl"
        out.setdefault((r["batch"], r["shard"]), []).append(json.loads(r["value"])["plan_id"])
        assert r["line"] == len(out[r["batch"], r["shard"]])
    return out


def test_shards_are_full_and_in_order(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert jsonl.append_batch(lines_of(spark, 95), folder, "one", ["k"], records=20)
    assert shards_of(spark, folder) == {("one", s): list(range(20 * s, min(20 * s + 20, 95))) for s in range(5)}
    assert jsonl.append_batch(lines_of(spark, 41, 500), folder, "two", ["k"], records=20)
    got = shards_of(spark, folder)
    assert [len(got[k]) for k in sorted(got)] == [20, 20, 20, 20, 15, 20, 20, 1] and got["two", 7] == [540]


def test_a_batch_counts_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "set")
    assert jsonl.append_batch(lines_of(spark, 30), folder, "day-1", ["k"], records=20)
    assert not jsonl.append_batch(lines_of(spark, 30), folder, "day-1", ["k"], records=20)
    assert sum(map(len, shards_of(spark, folder).values())) == 30
    # A run that ends after its lines and before its manifest row leaves nothing to be read ...
    plain = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: 1 / 0 if data and data[0][0] == "day-2" else plain(data, *a, **k))
    lines = lines_of(spark, 25, 100)
    with pytest.raises(ZeroDivisionError):
        jsonl.append_batch(lines, folder, "day-2", ["k"], records=20)
    monkeypatch.undo()
    assert sum(map(len, shards_of(spark, folder).values())) == 30
    # ... and the next run of the batch brings it in, once.
    assert jsonl.append_batch(lines, folder, "day-2", ["k"], records=20)
    assert not jsonl.append_batch(lines, folder, "day-2", ["k"], records=20)
    assert sorted(map(len, shards_of(spark, folder).values())) == [5, 10, 20, 20]


def test_empty_batches_and_names(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert jsonl.scan_set(spark, folder).collect() == [] and jsonl.manifest(spark, folder).collect() == []
    assert jsonl.append_batch(lines_of(spark, 3).limit(0), folder, "none", ["k"])
    assert jsonl.scan_set(spark, folder).collect() == [] and jsonl.manifest(spark, folder).count() == 1
    for name in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError, match="batch name"):
            jsonl.append_batch(lines_of(spark, 3), folder, name, ["k"])


def test_lenient_json(spark):
    rows = ['{"k": 3, "s": "x"}', '{"k": "no"}', "{}", '{"k": 1', "[1]", "7", "", None, '  {"k": 4}']
    lines = spark.createDataFrame([(v, i) for i, v in enumerate(rows)], "value string, i int")
    good, bad = jsonl.scan_json(lines, "k int, s string")
    assert sorted((r["i"], r["record"]["k"], r["record"]["s"]) for r in good.collect()) == [(0, 3, "x"), (1, None, None), (2, None, None), (8, 4, None)]
    assert sorted(r["i"] for r in bad.collect()) == [3, 4, 5, 6, 7] and good.columns == ["value", "i", "record"]
    assert good.schema["record"].dataType.fieldNames() == ["k", "s"]
