import json

import numpy as np
from pyspark.sql import functions as F

from planmill.operators import augment, regions, training_rows
from planmill.sources import jsonl


def record(**changes):
    base = {
        "plan_id": "1", "rooms": [{"rid": 1, "type": "bedroom", "coords": [0, 0, 0, 9, 9, 9]}],
        "edges": [], "front_door": None, "spatial": [],
    }
    return json.dumps({**base, **changes})


def test_ingest_reads_numbers_of_any_form(spark):
    room = {"rid": "3", "type": "bedroom", "coords": [1.0, "2", 3.9, 4]}
    rows = [
        record(plan_id="a", rooms=[room], spatial=[[1.0, "2", "right"]]),
        record(plan_id="b", spatial=[["a", 2, "right"]]),
        record(plan_id="c", edges=[{"pair": [None, 0], "doors": []}]),
        record(plan_id="d", spatial=[[1, 2, None]]),
        record(plan_id="e", rooms=[{"rid": "x", "type": "bedroom", "coords": []}]),
        record(plan_id="f", edges=[{"pair": [1], "doors": []}]),
        "{", record(plan_id="g", spatial=None),
    ]
    good, bad = jsonl.ingest(spark.createDataFrame([(r,) for r in rows], "value string"))
    kept = good.collect()
    assert [r.plan_id for r in kept] == ["a"]
    assert (kept[0].rooms[0].rid, kept[0].rooms[0].coords) == (3, [1, 2, 3, 4])
    assert (kept[0].spatial[0].rid_a, kept[0].spatial[0].rid_b) == (1, 2)
    reasons = {r.plan_id: r.reason for r in bad.collect()}
    assert reasons == {
        "b": "bad_relation", "c": "bad_pair", "d": "bad_relation", "e": "room_field", "f": "short_pair",
        None: "not_json", "g": "missing_spatial",
    }


def test_renumbering_leaves_out_what_has_no_numbers(spark):
    rows = [(str(n), 1, [(k, "bedroom", [0, 0, 0, 5, 5, 5]) for k in range(1, n + 1)]) for n in (3, 15, 16)]
    plans = spark.createDataFrame(rows, "plan_id string, variant int, rooms array<struct<rid:int,type:string,coords:array<int>>>").withColumns(
        {
            "edges": F.expr("array(named_struct('pair', array(1, 2), 'door', cast(array() as array<struct<x:double,y:double,w:double,h:double>>)))"),
            "spatial": F.expr("cast(array() as array<struct<rid_a:int,rid_b:int,direction:string>>)"),
        }
    )
    got = {r.plan_id: [q.rid for q in r.rooms] for r in augment.shuffle_rid(plans).collect()}
    assert set(got) == {"3", "15"} and all(len(set(v)) == len(v) and set(v) <= set(range(1, 16)) for v in got.values())
    assert [(r.plan_id, r.reason) for r in augment.split_unnumberable(plans)[1].collect()] == [("16", "too_many_rooms")]


def test_exchanges_account_for_every_user_turn(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "d"), (2, 1, "user", "e"), (2, 2, "assistant", "f")]
    got = {(r.conv_id, r.turn): r for r in training_rows.exchanges(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), "P").collect()}
    assert {k: r.status for k, r in got.items()} == {(1, 1): "answered", (1, 3): "unanswered", (2, 0): "unanswered", (2, 1): "answered"}
    say = lambda *pairs: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in pairs)
    assert got[1, 3].prefix_chat == say(("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c")) + "<|im_start|>assistant\n"
    assert got[2, 1].full_chat == say(("system", "P"), ("user", "d"), ("user", "e"), ("assistant", "f")) and got[1, 3].full_chat is None


def test_regions_of_runs_by_brute_force():
    own = np.random.default_rng(3)
    for connectivity in (4, 8):
        d = 0 if connectivity == 4 else 1
        for _ in range(40):
            runs = []
            for group in range(2):
                cells = own.random((own.integers(1, 9), own.integers(1, 12))) < 0.55
                for y, line in enumerate(cells):
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
                    runs += [(group, y, a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            parent = list(range(len(runs)))

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, (g, y, a, b) in enumerate(runs):
                for j in range(i):
                    h, z, p, q = runs[j]
                    if g == h and z == y - 1 and p <= b + d and q >= a - d:
                        m, n = find(i), find(j)
                        parent[max(m, n)] = min(m, n)
            columns = np.array(runs, np.int64).reshape(-1, 4).T
            assert regions.region_of_runs(*columns, connectivity).tolist() == [find(i) for i in range(len(runs))]
